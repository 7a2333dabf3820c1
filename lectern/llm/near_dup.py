"""MinHash near-duplicates by a multi-index Hamming join.

Each document becomes ``K`` b-bit MinHash symbols over word ``SHINGLE``-grams. The distance
of two signatures is the number of symbols that differ; documents are near duplicates when
it is at most ``MAX_DIST``. The join finds **every** such pair: the signature is split into
``CHUNKS`` chunks, chunk i may hold up to e_i errors, and sum(e_i + 1) > MAX_DIST means two
signatures within the threshold cannot exceed every chunk's allowance (generalised
pigeonhole). Allowed errors are enumerated by wildcards: one key per choice of e_i masked
symbols, so a pair within e_i errors in chunk i shares a key. Candidates are then compared
on the whole signature.

Groups are the connected components of the pairs within the threshold. Equal signatures are
folded into one before the join, and inside a bucket a spanning forest of verified pairs is
written rather than all of them, so groups of thousands of copies cost what they hold.

Defined cases: a document is a doc_id with a text. A null or wordless text has no signature, is in
no group and stays; a text of fewer than ``SHINGLE`` words is one shingle of all its words, one of any
length is read whole; a null doc_id is in no group, and the filter keeps such rows as they are. Of a
group the document with the smallest doc_id stays, ties going to the smaller hash of the text. Rows
that repeat both doc_id and text are one document, of which the filter keeps one row, the first by
its other columns as text; rows that repeat a doc_id with another text are documents of their own. An
empty table gives an empty result. Only doc_id and text are read, and further columns, whatever their
names, pass through the filter untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm._graph import by_close, components, forest, shared_keys
from lectern.llm._small import free, small
from lectern.llm._vec import U64, as_i64, mix, releasing, row_words, shingles, slices

SHINGLE, K, CHUNKS, MAX_DIST = 3, 64, 16, 31


def _permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_601)
    return rng.integers(0, 2**63, k, dtype=U64) * U64(2) + U64(1), rng.integers(0, 2**63, k, dtype=U64)


def signatures(col: pa.Array, shingle: int = SHINGLE, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(uint16 matrix of MinHash symbols, mask of the rows that have words)."""
    words, first = row_words(col)
    sh, at = shingles(words, first, shingle)
    has = np.diff(at) > 0
    sig = np.zeros((len(col), k), np.uint16)
    if has.any():
        cuts = at[:-1][has]
        mul, add = _permutations(k)
        for j in range(k):
            low = np.minimum.reduceat(sh * mul[j] + add[j], cuts)
            sig[has, j] = (mix(low) & U64(0xFFFF)).astype(np.uint16)
    return sig, has


def allowances(chunks: int = CHUNKS, max_dist: int = MAX_DIST) -> list[int]:
    """Errors allowed in each chunk: the least ones with sum(e + 1) > max_dist."""
    base, extra = divmod(max_dist + 1 - chunks, chunks)
    if max_dist + 1 < chunks:
        return [0] * (max_dist + 1)  # that many chunks suffice
    return [base + (i < extra) for i in range(chunks)]


def chunk_keys(sig: np.ndarray, chunks: int = CHUNKS, max_dist: int = MAX_DIST) -> np.ndarray:
    """(rows, keys) 64-bit keys: for every chunk, every choice of allowed errors as wildcards."""
    from itertools import combinations

    width = sig.shape[1] // chunks
    out = []
    with np.errstate(over="ignore"):
        for c, errors in enumerate(allowances(chunks, max_dist)):
            part = sig[:, c * width : (c + 1) * width].astype(U64)
            for gone in combinations(range(width), min(errors, width)):
                h = np.full(len(sig), c * 1009 + sum(1 << g for g in gone) + 1, U64)
                for j in range(width):
                    if j not in gone:
                        h = mix(h * U64(0x9E3779B97F4A7C15) + part[:, j] + U64(1))
                out.append(h)
    return np.stack(out, 1) if out else np.zeros((len(sig), 0), U64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi in slices(b.column("text")):
            sig, has = signatures(b.column("text").slice(lo, hi - lo))
            rows = np.flatnonzero(has)
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * K), len(rows), [None, pa.py_buffer(sig[rows].tobytes())])
            own = [b.column(c).slice(lo, hi - lo).take(pa.array(rows)) for c in ("doc_id", "h")]
            yield pa.RecordBatch.from_arrays([*own, raw.cast(pa.binary())], ["doc_id", "h", "sig"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint16).reshape(b.num_rows, K)
            keys = chunk_keys(sig)
            ids = np.repeat(b.column("id").to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(as_i64(keys.ravel())), pa.array(ids)], ["key", "id"])


def _close(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    a, b = one.view(np.uint16), many.view(np.uint16)
    return (a != b).sum(1) <= MAX_DIST


def groups(docs: DataFrame) -> DataFrame:
    """(group, doc_id, h, rows, n, first): each document with words, by the hash of its text, with its rows, its group, the group's documents and their first."""
    text = F.col("text").cast("string")
    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h")).where("doc_id is not null and text is not null")
    signed = chosen.mapInArrow(releasing(_sign), "doc_id bigint, h bigint, sig binary").checkpoint()
    reps = signed.select("sig").distinct().withColumn("id", F.monotonically_increasing_id()).checkpoint()  # numbers stand once written
    hits = shared_keys(reps.select("id", "sig").mapInArrow(releasing(_keys), "key bigint, id bigint"))
    pairs = forest(hits.join(reps, "id"), by_close(_close), "sig")
    named = reps.join(components(pairs), "id", "left").select("sig", F.coalesce("root", "id").alias("group"))
    members = signed.join(named, "sig").groupBy("group", "doc_id", "h").agg(F.count("*").alias("rows")).checkpoint()
    return members.join(members.groupBy("group").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "h")).alias("first")), "group")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, group_id, kept): the documents of every group of two or more; group_id is the smallest doc_id, whose document is kept."""
    return groups(docs).where("n > 1").select("doc_id", F.col("first.doc_id").alias("group_id"), F.expr("struct(doc_id, h) = first").alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group; the columns stay as they are.

    What goes is broadcast where its measured size allows, so that no text is shuffled; beyond that
    the texts are shuffled once, by doc_id and hash. Only rows that are there more than once meet in a window.
    """
    goes, hash_ = free("goes", docs.columns), free("hash", docs.columns)
    known = groups(docs).where("n > 1 or rows > 1").select(F.col("doc_id").alias(goes), F.col("h").alias(hash_), F.expr("struct(doc_id, h) <> first").alias("loses"), "rows").checkpoint()

    def matches(keys: DataFrame) -> Column:
        return (docs["doc_id"].cast("bigint") == keys[goes]) & (F.xxhash64(docs["text"].cast("string")) == keys[hash_])

    kept = docs.join(out := small(known.where("loses").drop("loses", "rows")), matches(out), "left_anti")
    again = known.where("not loses and rows > 1").drop("loses", "rows")
    if again.isEmpty():
        return kept
    again = small(again)
    twice = docs.join(again, matches(again), "left_semi").select(F.struct("*").alias("row"))
    rank = Window.partitionBy("row.doc_id", F.xxhash64("row.text")).orderBy(F.to_json("row"))
    first = twice.withColumn("place", F.row_number().over(rank)).where("place = 1").select("row.*")
    return kept.join(again, matches(again), "left_anti").unionByName(first)
