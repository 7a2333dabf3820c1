"""Byte-pair encoding against a public encoder, and exact round trips."""

import base64
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import bpe
from lectern.llm._vec import column_bytes
from lectern.llm.queries import VOCABULARY

PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def raw():
    with open(VOCABULARY, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def public(raw):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(raw, texts):
    import pyarrow as pa

    ids, first = bpe.codec(raw).encode(*column_bytes(pa.array(texts, pa.string())))
    return [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]


@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab'stlredvm019 \n\t\r.,!é ß中　\U0001f600"), st.characters(exclude_categories=["Cs", "Cn", "Co"])), max_size=40), min_size=1, max_size=6))
@settings(max_examples=300, deadline=None)
def test_as_the_public_encoder(raw, public, texts):
    assert encoded(raw, texts) == [public.encode_ordinary(t) for t in texts]


def test_documents(spark, sf, raw, public):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = bpe.encode(docs, VOCABULARY, ("doc_id", "text")).collect()
    assert all(r.exact and r.n_tokens == len(r.token_ids) for r in rows)
    assert [r.token_ids for r in rows] == [public.encode_ordinary(r.text) for r in rows]
    back = bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY)
    assert {(r.doc_id, r.text) for r in back.collect()} == {(r.doc_id, r.text) for r in docs.collect()}


def test_merges_of_long_tokens(raw, public):
    ranks = bpe.codec(raw).ranks
    rng = random.Random(1)
    for t in ["a" * 5000, "ab" * 2000, "".join(rng.choice("abcde") for _ in range(3000))]:
        assert bpe.merge_bytes(t.encode(), ranks) == public.encode_ordinary(t)


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(3).integers(0, 2**63, 5000).astype(np.uint64))
    h = bpe.PerfectHash(keys)
    assert sorted(h(keys).tolist()) == list(range(len(keys)))


def test_defined_cases(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "x" * 1_000_000, 3), (None, "hi", 4), (2, "", 2)], "doc_id bigint, text string, token_ids int")
    rows = bpe.encode(df, VOCABULARY).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 5 and by[1].token_ids is None and by[1].n_tokens is None and by[1].exact is None
    assert by[2].token_ids == [] and by[2].exact and by[3].exact and by[None].n_tokens == 1
    assert bpe.encode(df.limit(0), VOCABULARY).count() == 0
    ids = spark.createDataFrame([(1, None), (2, []), (3, [-1, 10**6, None, 72]), (4, [255, 0])], "doc_id int, token_ids array<int>")
    out = {r.doc_id: r.text for r in bpe.decode(ids, VOCABULARY).collect()}
    assert out[1] is None and out[2] == "" and len(out[3]) == 1 and isinstance(out[4], str)
