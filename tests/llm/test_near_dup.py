"""Near duplicates and fingerprints against brute force."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import fingerprints, near_dup
from lectern.llm._graph import by_close, components, forest
from lectern.llm._small import small

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, sig int, key string, group_id int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, "k", 9) for i, t in rows], SCHEMA)


def made(seed=3, n=60):
    """Texts with copies at many distances, from equal to unrelated."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(n // 6):
        base = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        for changes in (0, 0, 1, 3, 8, 20):
            own = list(base)
            for _ in range(changes):
                own[rng.randrange(len(own))] = rng.choice(words)
            out.append(" ".join(own))
    return out


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in range(n)}


def test_groups_are_exactly_the_components_of_close_signatures(spark):
    texts = made()
    sig, has = near_dup.signatures(pa.array(texts))
    assert has.all()
    close = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if (sig[i] != sig[j]).sum() <= near_dup.MAX_DIST]
    want = roots(len(texts), close)
    want = {i: r for i, r in want.items() if list(want.values()).count(r) > 1}
    got = {r.doc_id: r.group_id for r in near_dup.near_duplicates(frame(spark, enumerate(texts))).collect()}
    assert got == want and len(want) > 20


def test_every_pair_within_the_threshold_shares_a_key():
    rng = np.random.default_rng(1)
    assert sum(e + 1 for e in near_dup.allowances()) > near_dup.MAX_DIST
    for distance in (0, 1, 15, 16, near_dup.MAX_DIST):
        a = rng.integers(0, 65536, (200, near_dup.K)).astype(np.uint16)
        b = a.copy()
        for r in range(len(b)):
            at = rng.choice(near_dup.K, distance, replace=False)
            b[r, at] ^= rng.integers(1, 65536, distance).astype(np.uint16)
        x, y = near_dup.chunk_keys(a), near_dup.chunk_keys(b)
        assert (x == y).any(1).all()


@pytest.mark.parametrize(("chunks", "max_dist"), [(16, 31), (8, 3), (4, 10), (16, 15)])
def test_allowances(chunks, max_dist):
    assert sum(e + 1 for e in near_dup.allowances(chunks, max_dist)) == max_dist + 1


def test_defined_cases(spark):
    long = "word " * 200_000
    base = " ".join(f"t{i}" for i in range(80))
    rows = [(1, base), (2, base + " end"), (2, "quite other words that are here"), (3, None), (4, ""), (5, "..."), (None, base), (None, base), (6, "one"), (7, "one"), (8, long), (9, long), (10, "alone with these words")]
    docs = frame(spark, rows)
    got = {(r.doc_id, r.group_id, r.kept) for r in near_dup.near_duplicates(docs).collect()}
    assert got == {(1, 1, True), (2, 1, False), (6, 6, True), (7, 6, False), (8, 8, True), (9, 8, False)}
    kept = near_dup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 5, None, None, 6, 8, 10]))
    same = frame(spark, [(5, "b b b b"), (5, "a a a a"), (5, None), (5, "a a a a"), (5, None)])
    assert sorted(str(r.text) for r in near_dup.drop_near_duplicates(same).collect()) == ["None", "None", "a a a a", "b b b b"]
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0 and near_dup.drop_near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_names_that_clash_and_either_join(spark, monkeypatch, limit):
    monkeypatch.setattr(near_dup, "small", lambda df: small(df, limit))
    docs = spark.createDataFrame([(1, "x y z w", 7, 1), (1, "x y z w", 6, 2), (2, "x y z w v", 7, 3), (3, "quite other words", 7, 4)], "doc_id int, text string, goes int, hash int")
    docs = docs.withColumnsRenamed({"hash": "Goes_"}).withColumns({"hash": F.lit(1), "__gone": F.lit(2), "__row": F.lit(3)})
    kept = near_dup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    groups = {frozenset(g) for g in ((1, 3), (1, 2, 3))}
    assert frozenset(r.doc_id for r in kept.collect()) in groups and kept.where("doc_id = 1").collect()[0].goes == 6


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(40)]
    want = roots(200, pairs)
    touched = {x for p in pairs if p[0] != p[1] for x in p}
    got = {r.id: r.root for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {i: want[i] for i in touched}


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(last[j - 1] if x == y else 1 + min(last[j], row[j - 1]))
    return row[-1]


def matches(p, q) -> bool:
    for n, s in ((p[1], p[2]), (p[1] * 2, p[3])):
        for m, t in ((q[1], q[2]), (q[1] * 2, q[3])):
            if n == m and {s[i : i + fingerprints.GRAM] for i in range(len(s) - fingerprints.GRAM + 1)} & {t[i : i + fingerprints.GRAM] for i in range(len(t) - fingerprints.GRAM + 1)}:
                if int(100 * (1 - edits(s, t) / (len(s) + len(t))) + 1e-9) >= fingerprints.MIN_SCORE:
                    return True
    return False


def test_families_are_the_components_of_matching_signatures(spark):
    texts = [t * 4 for t in made(7, 48)] + ["short", "short", ""]
    out = fingerprints.document_fingerprints(frame(spark, enumerate(texts))).orderBy("doc_id").collect()
    prints = [(r.doc_id, r.block_size, r.signature, r.signature2) for r in out]
    pairs = [(p[0], q[0]) for p, q in itertools.combinations(prints, 2) if matches(p, q) or texts[p[0]] == texts[q[0]] != ""]
    assert {r.doc_id: r.family for r in out} == roots(len(texts), pairs)
    assert len(pairs) > 20


def reference_print(data: bytes, size: int) -> bytes:
    """The signature as its definition has it, byte by byte."""
    from lectern.llm._vec import U64, mix

    with np.errstate(over="ignore"):
        roll = [mix(np.array([sum(int(fingerprints._TABLE[data[i - k]]) * (2 * k + 3) for k in range(min(7, i + 1))) % 2**64], U64))[0] >> U64(32) for i in range(len(data))]
        body = [int(mix(np.array([int(roll[i]) * 256 + data[i]], U64))[0]) for i in range(len(data))]
    cuts = [i + 1 for i in range(len(data)) if int(roll[i]) % size == size - 1][: fingerprints.LENGTH - 1]
    edges = [0, *cuts] + ([len(data)] if not cuts or cuts[-1] != len(data) else [])
    out = b""
    for a, b in itertools.pairwise(edges):
        h = int(mix(np.array([sum(body[a:b]) % 2**64 ^ (b - a)], U64))[0]) >> 58
        out += bytes([fingerprints.SIGNS[h]])
    kept = b""
    for i in range(len(out)):
        kept += b"" if i >= 3 and out[i] == out[i - 1] == out[i - 2] == out[i - 3] else out[i : i + 1]
    return kept


def test_signatures_by_definition():
    texts = ["a", "hello world " * 30, "é" * 50, "".join(random.Random(2).choice("abcdef ") for _ in range(3000)), "same", "same", "x" * 700]
    sizes, one, two, whole = fingerprints.fingerprint(pa.array([*texts, None, ""]))
    for t, n, s, d in zip(texts, sizes, one, two, strict=False):
        assert s == reference_print(t.encode(), int(n)) and d == reference_print(t.encode(), int(n) * 2)
    assert one[-1] == one[-2] == b"" and one[4] == one[5] and len(set(whole[: len(texts)].tolist())) == len(set(texts))


def padded(words):
    return np.array([list(w.encode().ljust(64, b"\0")) for w in words], np.uint8)


def test_distance():
    rng = random.Random(4)
    words = ["".join(rng.choice("ABC") for _ in range(rng.randint(0, 64))) for _ in range(40)]
    sig = fingerprints.Signatures(padded(words))
    for i, w in enumerate(words[:8]):
        assert sig.distance(np.full(len(words), i), np.arange(len(words))).tolist() == [edits(w, x) for x in words]


@pytest.mark.parametrize(("small", "pivots", "block"), [(64, 8, 1024), (3, 1, 4), (2, 50, 7)])
def test_buckets_of_any_size_lose_no_link(monkeypatch, small, pivots, block):
    """Whatever is compared all at once, by pivots or by blocks: the components are those of all pairs in a bucket."""
    for name, value in (("SMALL", small), ("PIVOTS", pivots), ("BLOCK", block), ("PAIRS", 50)):
        monkeypatch.setattr(fingerprints, name, value)
    rng = random.Random(9)
    seeds = ["".join(rng.choice("ABCDEFGH") for _ in range(50)) for _ in range(12)]
    words = []
    for _ in range(90):
        w = list(rng.choice(seeds))
        for _ in range(rng.choice([0, 5, 15, 25])):
            w[rng.randrange(50)] = rng.choice("ABCDEFGH")
        words.append("".join(w))
    ends = [1, 3, 33, 90]
    s, e = np.array([0, *ends[:-1]]), np.array(ends)
    pairs = [(i, j) for a, b in zip(s, e, strict=True) for i in range(a, b) for j in range(i + 1, b) if int(100 * (1 - edits(words[i], words[j]) / 100) + 1e-9) >= fingerprints.MIN_SCORE]
    a, b = fingerprints.links(padded(words), s, e)
    assert roots(90, list(zip(a.tolist(), b.tolist(), strict=True))) == roots(90, pairs) and len(pairs) > 30


def test_buckets_cut_into_blocks_lose_no_link(spark):
    rows = [(k % 3, i, 60 if k % 3 == 0 else 30, bytearray(bytes([i % 7 + 1]) * 64)) for k in range(3) for i in range(60 if k == 0 else 30)]
    members = spark.createDataFrame(rows, "key bigint, id bigint, n bigint, sig binary")
    close = by_close(lambda one, many: (one != many).sum(1) == 0)
    for split in (1000, 7):
        edges = [(r.a, r.b) for r in forest(members, close, "sig", split).collect()]
        assert roots(60, edges) == {i: i % 7 for i in range(60)}


def test_fingerprint_cases(spark):
    docs = frame(spark, [(1, None), (2, ""), (None, "some text that is long enough to have seven pieces in it, or more than that"), (3, "z" * 2_000_000), (3, "other")])
    rows = fingerprints.document_fingerprints(docs).collect()
    assert len(rows) == 5
    by = {(r.doc_id, r.signature is None): r for r in rows}
    assert by[1, True].family is None and by[2, False].signature == "" and by[2, False].family == 2
    short = frame(spark, [(4, "hello there"), (5, "hello there"), (6, "hello"), (7, ""), (8, "")])
    assert {r.doc_id: r.family for r in fingerprints.document_fingerprints(short).collect()} == {4: 4, 5: 4, 6: 6, 7: 7, 8: 8}
    assert fingerprints.document_fingerprints(docs.limit(0)).count() == 0
