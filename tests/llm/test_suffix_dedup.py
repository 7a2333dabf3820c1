"""Repeated passages against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import suffix_dedup as sd
from lectern.llm._vec import row_words

SCHEMA = "doc_id bigint, text string, id int, key string, hot string, place int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "k", "h", 2) for i, t in rows], SCHEMA)


def brute(rows, length, across=True):
    """{doc_id: words of windows that another document (or place) also has}."""
    words = [(i, re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", (t or "").lower())) for i, t in rows if i is not None]
    seen = {}
    for n, (i, w) in enumerate(words):
        for k in range(len(w) - length + 1):
            seen.setdefault(tuple(w[k : k + length]), set()).add(i if across else (n, k))
    out = {}
    for i, w in words:
        for k in range(len(w) - length + 1):
            if len(seen[tuple(w[k : k + length])]) > 1:
                out.setdefault(i, set()).update(range(k, k + length))
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, set()).update(range(r.start_word, r.start_word + r.n_words))
    return out


@given(st.lists(st.integers(0, 3), max_size=120))
@settings(max_examples=60, deadline=None)
def test_suffix_array_and_prefixes(x):
    text = np.array(x, np.int64)
    sa, rank = sd.suffix_array(text)
    want = sorted(range(len(x)), key=lambda i: x[i:])
    assert sa.tolist() == want and all(rank[s] == r for r, s in enumerate(sa.tolist()))
    lcp = sd.kasai(text, sa, rank)
    for r in range(1, len(x)):
        a, b, n = x[want[r - 1] :], x[want[r] :], 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert lcp[r] == n


def made(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["é1", "Ünd"]
    passages = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 30))) for _ in range(6)]
    rows = []
    for i in range(40):
        parts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 25))) for _ in range(3)]
        for p in rng.sample(passages, rng.randint(0, 2)):
            parts.insert(rng.randrange(len(parts) + 1), p.upper() if rng.random() < 0.3 else p)
        rows.append((i, ", ".join(parts)))
    return rows


@pytest.mark.parametrize(("seed", "shard"), [(1, 1_000_000), (2, 60), (3, 300)])
def test_exact_for_any_sharding(spark, seed, shard):
    rows = made(seed)
    want = brute(rows, 12)
    got = sd.repeated_passages(frame(spark, rows), min_words=12, gram=4, shard_words=shard)
    assert found(got) == want and len(want) > 10
    for r in got.collect():
        text = dict(rows)[r.doc_id][r.start_char : r.end_char]
        assert len(re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text)) == r.n_words


def test_inside_one_document(spark):
    p = " ".join(f"p{i}" for i in range(14))
    rows = [(1, f"{p} middle {p}"), (2, "x y z"), (3, p[:-4])]
    assert found(sd.repeated_passages(frame(spark, rows), min_words=12, gram=4)) == brute(rows, 12)
    assert found(sd.repeated_passages(frame(spark, rows), min_words=12, gram=4, across=False)) == brute(rows, 12, across=False)


def test_defined_cases(spark):
    p = " ".join(f"Wort{i}" for i in range(60))
    long = " ".join(f"n{i}" for i in range(150_000))
    rows = [(1, p), (1, p), (2, None), (3, ""), (None, p), (4, "short"), (5, long), (6, "intro " + long)]
    got = {(r.doc_id, r.start_word, r.n_words) for r in sd.repeated_passages(frame(spark, rows)).collect()}
    assert got == {(5, 0, 150_000), (6, 1, 150_000)}
    got = sd.repeated_passages(frame(spark, [(1, "äö " + p + "!"), (2, p.lower() + " x")])).orderBy("doc_id").collect()
    assert [(r.start_char, r.end_char, r.n_words) for r in got] == [(3, 3 + len(p), 60), (0, len(p), 60)]
    assert sd.repeated_passages(frame(spark, rows).limit(0)).count() == 0


def test_many_copies_of_one_document(spark):
    p = " ".join(f"c{i}" for i in range(70))
    rows = [(i, f"{p} own{i}") for i in range(300)]
    assert found(sd.repeated_passages(frame(spark, rows), shard_words=2000)) == {i: set(range(70)) for i in range(300)}


@pytest.mark.parametrize("across", [True, False])
def test_exact_where_hashes_collide(monkeypatch, across):
    """Window hashes of four bits: what tells windows of different shards apart is the second hash."""
    whole = sd.window_keys
    monkeypatch.setattr(sd, "window_keys", lambda words, length: (whole(words, length)[0] & np.uint64(15), whole(words, length)[1]))
    rows = made(4)
    hot = pa.array([sorted({int(x) for x in sd.window_names(*words_of(t), 12, 4)[0].view(np.int64)}) for _, t in rows], pa.list_(pa.int64()))
    n = len(rows)
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows]), hot, hot, pa.array(range(n)), pa.array([0] * n)], ["doc_id", "text", "hot", "cross", "place", "salt"])
    segments = list(sd._cut(12, 4)(iter([batch])))
    records = pa.Table.from_batches(list(sd._shards(12, 4, across, 60)(iter(segments))))
    settled = records.filter(records["settled"]).to_pylist()
    rest = records.filter(pc.invert(records["settled"])).sort_by("key")
    merged = [r for b in sd._merge(across)(iter(rest.combine_chunks().to_batches())) for r in b.to_pylist()]
    out = {}
    for r in [*({**x, "doc_id": x["id"]} for x in settled), *merged]:
        out.setdefault(r["doc_id"], set()).update(range(r["w0"], r["w1"]))
    assert out == brute(rows, 12, across) and len({r["shard"] for r in records.to_pylist()}) > 5


def words_of(text):
    return row_words(pa.array([text]))


@pytest.mark.parametrize("seed", [1, 5])
def test_dropped_repeats_against_brute_force(spark, seed):
    """Of equal windows the first stays; words of the others go."""
    rows = made(seed)
    words = [(i, [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", t)]) for i, t in rows]
    first, gone = {}, {}
    repeated = brute(rows, 12)
    for i, w in words:
        for k in range(len(w) - 11):
            key = tuple(x[0] for x in w[k : k + 12])
            if first.setdefault(key, (i, k)) != (i, k) and set(range(k, k + 12)) <= repeated.get(i, set()):
                gone.setdefault(i, set()).update(range(k, k + 12))
    want = {}
    for (i, w), (_, text) in zip(words, rows, strict=True):
        out, at = "", 0
        for a in sorted(gone.get(i, ())):
            if a - 1 not in gone[i]:
                out += text[at : w[a][1]]
            at = w[a][2]
        want[i] = out + text[at:]
    docs = frame(spark, rows).withColumn("n_chars", F.length("text")).withColumn("cuts", F.lit(3))
    got = sd.drop_repeated(docs, 12, 4)
    assert got.columns == docs.columns and got.schema == docs.schema
    rows_out = got.collect()
    assert {r.doc_id: r.text for r in rows_out} == want and sum(map(len, want.values())) < sum(len(t) for _, t in rows)
    assert all(r.n_chars == len(r.text) for r in rows_out)


def test_dropped_repeats_in_odd_tables(spark):
    p = " ".join(f"Wort{i}" for i in range(60))
    rows = [(1, "äö " + p + "!"), (2, p.lower() + " x"), (3, p), (3, p), (4, None), (None, p), (5, "")]
    got = sorted(((r.doc_id, r.text) for r in sd.drop_repeated(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(1, "äö " + p + "!"), (2, " x"), (3, p), (3, p), (4, None), (None, p), (5, "")], key=str)
    assert sd.drop_repeated(frame(spark, rows).limit(0)).count() == 0
