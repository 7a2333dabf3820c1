"""Similarity graphs: exact connectivity from bucketed candidates, without listing all pairs.

``shared_keys`` keeps the (key, id, n) rows whose key n > 1 ids share, once for keys with the same ids.
``forest`` compares the members of each bucket for real and writes edges that connect what its
verified pairs connect, so a bucket costs as many rows as it has members. A bucket of more than
``SPLIT`` members is cut into blocks, and every two blocks meet in a task of their own: no task
holds more than two blocks, and none of the bucket's pairs is lost. ``components`` labels every node
with the smallest id it can reach.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm._vec import U64, mix, runs

SPLIT = 8192
#: Edges among the rows of buckets [s, e): (rows, rows), enough to connect what verified pairs connect.
Links = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that never cut a run of equal ``key``; input is sorted by key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(key, key[-1], "left"))
        if last == 0 and held and held[-1].column("key")[-1].as_py() == key[0]:
            held.append(batch)
            continue
        if last:
            held.append(batch.slice(0, last))
        if held:
            yield pa.Table.from_batches(held)
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _by_key(batches):
        key, ids = t["key"].to_numpy(), t["id"].to_numpy()
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
        key, ids = key[fresh], ids[fresh]
        s, e = runs(key)
        keep = np.repeat(e - s > 1, e - s)
        n = np.repeat(e - s, e - s)
        if len(key):  # keys of the same ids get one name
            key = np.repeat(mix(np.add.reduceat(mix(ids.view(U64)), s) + (e - s).astype(U64)), e - s).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(ids[keep]), pa.array(n[keep])], ["key", "id", "n"])


def shared_keys(keys: DataFrame) -> DataFrame:
    """(key, id, n) rows of the sets of n > 1 ids that share a key, each set once and under a new key.

    ``keys`` has bigint key and id. Two sets that get the same new key by chance become one bucket,
    which costs comparisons and loses nothing.
    """
    ordered = keys.repartition("key").sortWithinPartitions("key", "id")
    return ordered.mapInArrow(_shared, "key bigint, id bigint, n bigint").distinct()


def by_close(close: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Links:
    """Breadth-first walk of each bucket; ``close(one, many)`` says which rows of ``many`` are within the threshold of ``one``."""

    def links(raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        p = s[e - s == 2]
        if len(p):  # most buckets hold one pair: all of them at once
            p = p[close(raw[p], raw[p + 1])]
            left.append(p)
            right.append(p + 1)
        for lo, hi in zip(s[e - s > 2].tolist(), e[e - s > 2].tolist(), strict=True):
            rest, front = np.arange(lo + 1, hi), [lo]
            while len(rest):
                if not front:
                    front, rest = [int(rest[0])], rest[1:]
                    continue
                at = front.pop()
                ok = close(raw[at : at + 1], raw[rest])
                if ok.any():
                    left.append(np.full(ok.sum(), at))
                    right.append(rest[ok])
                    front += rest[ok].tolist()
                    rest = rest[~ok]
        return np.concatenate(left), np.concatenate(right)

    return links


def forest(members: DataFrame, links: Links, payload: str, split: int = SPLIT) -> DataFrame:
    """(a, b) edges, a < b, that connect what each bucket's verified pairs connect.

    ``members`` has key, id, n (members of the key) and ``payload`` (binary, of one length), which
    ``links`` gets as rows of uint8.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_key(batches):
            ids = t["id"].to_numpy()
            col = t[payload].combine_chunks()
            width = len(col[0].as_py()) if len(col) else 0
            raw = np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(len(col), width)
            a, b = links(raw, *runs(t["key"].to_numpy()))
            if len(a):
                pair = np.unique(np.stack([np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    blocks = F.ceil(F.col("n") / F.lit(split))
    own = F.pmod(F.xxhash64("id", "key"), blocks)
    meets = F.transform(F.sequence(F.lit(0).cast("bigint"), blocks - 1), lambda j: F.xxhash64("key", "n", F.least(own, j), F.greatest(own, j)))
    placed = members.select(F.explode(F.when(blocks > 1, meets).otherwise(F.array(F.xxhash64("key", "n")))).alias("key"), "id", payload)
    ordered = placed.repartition("key").sortWithinPartitions("key", "id")
    return ordered.mapInArrow(walk, "a bigint, b bigint").where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root): every node of ``edges`` (a, b) with the smallest id of its component.

    Alternating large-star and small-star rounds; each round is a checkpoint in the shared
    folder, so lineage stays short and a lost executor costs one round at most.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct().checkpoint()
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = small.select("e.u", "e.v").where("u <> v").distinct().checkpoint()
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    roots = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct())
