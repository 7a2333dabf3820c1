"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last seven bytes ends a piece wherever it hits the block size's trigger, so
an edit moves only the pieces around it. Each piece becomes one of 64 signs. The block size is
3 * 2^i, the least with at most ``LENGTH`` expected pieces, halved until the signature has half
that many; a second signature uses twice the block size. Pieces past ``LENGTH - 1`` join the last
one, so every byte counts; runs of a sign longer than three are cut to three.

Two documents match if, at a block size they share, both signatures hold a common run of ``GRAM``
signs and their edit distance (insertions and deletions; a change is both) gives a score of at
least ``MIN_SCORE``: 100 * (1 - distance / (length + length)). All documents are compared: runs
are the join key, equal signatures are folded first, and inside a run's bucket every pair that the
signs in common leave open is measured, but only what connects the matches is written. A family is a
connected component of matches.

Defined cases: a null text has null signatures and no family; an empty text has empty signatures
at the least block size and is a family of its own; a signature shorter than ``GRAM`` says too little,
so documents with such a one match if their texts are equal (by a 64-bit hash, beside signature and
block size); a text of any length is read whole; a null doc_id is fingerprinted but joins no family;
rows that repeat a doc_id are fingerprinted each and share the family of that doc_id; the family is
the smallest doc_id in it, and a document that matches none has its own doc_id; ties can't arise; an
empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm._graph import components, forest, shared_keys
from lectern.llm._vec import U64, as_i64, column_bytes, mix, slices

LENGTH, GRAM, MIN_SCORE, LEAST = 64, 7, 60, 3
SIGNS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_TABLE = np.random.default_rng(97).integers(1, 2**63, 256, dtype=U64)


def rolling(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """32-bit hash of the up to seven bytes of the row that end at each byte."""
    n = len(data) - 16
    h = np.zeros(n, U64)
    t = _TABLE[data[:n]]
    for back in range(7):
        h[back:] += t[: n - back] * U64(2 * back + 3) if n > back else U64(0)
    rows = ends > starts
    for back in range(1, 7):  # take away what belongs to the row before
        for first in range(back):
            at = starts[rows] + first
            at = at[(at < ends[rows]) & (at >= back)]
            h[at] -= t[at - back] * U64(2 * back + 3)
    return (mix(h) >> U64(32)).astype(np.uint32)


def _exponent(n: np.ndarray) -> np.ndarray:
    """Least i with 3 * 2^i * LENGTH >= n."""
    return np.ceil(np.log2(np.maximum(n, LEAST * LENGTH) / (LEAST * LENGTH))).astype(np.int64)


def _pieces(roll: np.ndarray, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, exp: np.ndarray) -> list[bytes]:
    """Signature of each row at its block size LEAST * 2^exp."""
    n = ends - starts
    row = np.repeat(np.arange(len(n)), n)
    order = starts[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    size = (np.uint32(LEAST) << exp.astype(np.uint32))[row]
    stop = order[roll[order] % size == size - 1] + 1  # a piece ends behind its trigger
    first = np.searchsorted(stop, starts, "right")
    last = np.searchsorted(stop, ends, "right")
    out = []
    for r in range(len(n)):
        cut = stop[first[r] : last[r]][: LENGTH - 1]
        if n[r] == 0:
            out.append(b"")
            continue
        edges = np.concatenate([[starts[r]], cut, [ends[r]]]) if not len(cut) or cut[-1] != ends[r] else np.concatenate([[starts[r]], cut])
        a, b = edges[:-1], edges[1:]
        sign = SIGNS[(mix((prefix[b] - prefix[a]) ^ (b - a).astype(U64)) >> U64(58)).astype(np.int64)]
        if len(sign) > 3:
            same = (sign[3:] == sign[2:-1]) & (sign[2:-1] == sign[1:-2]) & (sign[1:-2] == sign[:-3])
            sign = np.concatenate([sign[:3], sign[3:][~same]])
        out.append(sign.tobytes())
    return out


def fingerprint(col: pa.Array) -> tuple[np.ndarray, list[bytes], list[bytes], np.ndarray]:
    """(block sizes, signatures, signatures at twice the block size, hashes of the whole texts) of the rows."""
    data, starts, ends = column_bytes(col)
    n = len(data) - 16
    if n <= 0:
        return np.full(len(col), LEAST), [b""] * len(col), [b""] * len(col), np.zeros(len(col), U64)
    roll = rolling(data, starts, ends)
    # pieces are sums of mixed bytes that know the seven bytes before them, so their order counts
    prefix = np.concatenate([[U64(0)], np.cumsum(mix(roll.astype(U64) * U64(256) + data[:n]))])
    exp = _exponent(ends - starts)
    one = _pieces(roll, prefix, starts, ends, exp)
    while True:
        short = np.array([i for i, x in enumerate(one) if len(x) < LENGTH // 2 and exp[i] > 0], np.int64)
        if not len(short):
            break
        exp[short] -= 1
        again = _pieces(roll, prefix, starts[short], ends[short], exp[short])
        for i, x in zip(short.tolist(), again, strict=True):
            one[i] = x
    return LEAST << exp, one, _pieces(roll, prefix, starts, ends, exp + 1), mix((prefix[ends] - prefix[starts]) ^ (ends - starts).astype(U64))


_CODE = np.full(256, 64, np.uint8)
_CODE[SIGNS] = np.arange(64)
SMALL, PIVOTS, BLOCK, PAIRS = 64, 8, 1024, 1 << 17


class Signatures:
    """Signatures (rows of signs, padded with 0) laid out for comparisons of many pairs at once."""

    def __init__(self, raw: np.ndarray) -> None:
        self.code = _CODE[raw]
        self.size = (raw > 0).sum(1)
        n, width = raw.shape
        rows = np.arange(n)
        self.places = np.zeros((n, 65), U64)  # bit j: the sign is at place j; the last column is padding and has none
        self.count = np.zeros((n, 65), np.uint8)
        for j in range(width):
            self.places[rows, self.code[:, j]] |= U64(1 << j)
            self.count[rows, self.code[:, j]] += 1
        self.places[:, 64] = 0
        self.count = np.ascontiguousarray(self.count[:, :64])

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Insertions and deletions between rows a and b: a bit-parallel longest common subsequence."""
        v = np.full(len(a), ~U64(0))
        flat, at, code = self.places.ravel(), b * 65, self.code[a]
        for j in range(int(self.size[a].max(initial=0))):
            u = v & flat[at + code[:, j]]
            v = (v + u) | (v - u)
        return self.size[a] + self.size[b] - 2 * (64 - np.bitwise_count(v).astype(np.int64))

    def scores(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Score from 0 to 100 of the pairs."""
        return np.floor(100 * (1 - self.distance(a, b) / np.maximum(self.size[a] + self.size[b], 1)) + 1e-9).astype(np.int64)

    def match(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs reach ``MIN_SCORE``; only those whose signs in common, each as often as both have it, allow it are measured."""
        out = np.zeros(len(a), bool)
        for lo in range(0, len(a), PAIRS):
            x, y = a[lo : lo + PAIRS], b[lo : lo + PAIRS]
            shared = np.minimum(self.count[x], self.count[y]).sum(1, dtype=np.int64)
            may = np.flatnonzero(200 * shared >= MIN_SCORE * (self.size[x] + self.size[y]))
            out[lo + may] = self.scores(x[may], y[may]) >= MIN_SCORE
        return out

    def candidates(self, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (of left, of right) whose signs in common allow a match, block by block: counts as levels, so that a product adds up their minima."""
        levels = self.count[np.concatenate([left, right])]
        one = np.concatenate([levels >= k for k in range(1, int(levels.max(initial=0)) + 1)], 1).astype(np.float32)
        one = one[:, one.any(0)]
        l, r = one[: len(left)], np.ascontiguousarray(one[len(left) :].T)
        for lo in range(0, len(left), BLOCK):
            rows = left[lo : lo + BLOCK]
            i, j = np.nonzero(200 * (l[lo : lo + BLOCK] @ r) >= MIN_SCORE * (self.size[rows][:, None] + self.size[right]) - 0.5)
            yield rows[i], right[j]


def _connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least row that each row is connected with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for x in (a, b, label[a], label[b]):
            np.minimum.at(new, x, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def links(raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, least row it is connected with) in the buckets [s, e).

    Small buckets are compared pair by pair, all of them at once. In a large one a few pivots take
    what is like them; what is left is compared block by block.
    """
    sig, n, size = Signatures(raw), len(raw), e - s
    few = size <= SMALL
    rows = np.concatenate([np.zeros(0, np.int64), *(np.arange(x, y) for x, y in zip(s[few].tolist(), e[few].tolist(), strict=True))])
    end = np.repeat(e[few], size[few])
    left, right = [], []
    for d in range(1, int(size[few].max(initial=1))):
        rows, end = rows[rows + d < end], end[rows + d < end]
        hit = rows[sig.match(rows, rows + d)]
        left.append(hit)
        right.append(hit + d)
    for lo, hi in zip(s[~few].tolist(), e[~few].tolist(), strict=True):
        rest, front, done = np.arange(lo + 1, hi), [lo], 0
        while len(rest):
            if not front:
                front, rest = [int(rest[0])], rest[1:]
                continue
            at = front.pop()
            ok = sig.match(np.full(len(rest), at), rest)
            left.append(np.full(ok.sum(), at))
            right.append(rest[ok])
            front += rest[ok].tolist()
            done = 0 if 20 * ok.sum() > len(rest) else done + 1  # pivots that find little
            rest = rest[~ok]
            if done >= PIVOTS:
                break
        if len(rest):
            for a, b in sig.candidates(np.concatenate([np.array(front, np.int64), rest]), rest):
                own = (a < b) | ~np.isin(a, rest)  # pairs within the rest come twice
                a, b = a[own], b[own]
                ok = sig.match(a, b)
                left.append(a[ok])
                right.append(b[ok])
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (left, right))
    label = _connected(n, a, b)
    member = np.flatnonzero(label != np.arange(n))
    return label[member], member


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi in slices(b.column("text"), 2 << 20):
            part = b.column("text").slice(lo, hi - lo)
            size, one, two, whole = fingerprint(part)
            gone = np.asarray(part.is_null())
            text = [pa.array([None if g else x.decode() for x, g in zip(s, gone, strict=True)], pa.string()) for s in (one, two)]
            cols = [b.column("doc_id").slice(lo, hi - lo), pa.array(size, mask=gone), *text, pa.array(as_i64(whole), mask=gone)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "block_size", "signature", "signature2", "whole"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, block_size, signature, signature2, whole) of every row; whole is a hash of all its bytes."""
    chosen = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return chosen.mapInArrow(_fingerprints, "doc_id bigint, block_size bigint, signature string, signature2 string, whole bigint")


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        raw = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint8).reshape(b.num_rows, LENGTH)
        size = b.column("size").to_numpy().astype(U64)
        keys, ids = [], []
        id_ = b.column("id").to_numpy()
        for j in range(LENGTH - GRAM + 1):
            rows = np.flatnonzero(raw[:, j + GRAM - 1] > 0)
            h = mix(size[rows])
            for k in range(GRAM):
                h = h * U64(0x9E3779B97F4A7C15) + raw[rows, j + k].astype(U64)
            keys.append(as_i64(mix(h)))
            ids.append(id_[rows])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(ids))], ["key", "id"])


def families(prints: DataFrame) -> DataFrame:
    """(doc_id, family) of every document of ``prints`` that matches another."""
    known = prints.where("doc_id is not null and signature <> ''")
    both = F.array(F.struct(F.col("block_size").alias("size"), F.col("signature").alias("s")), F.struct((F.col("block_size") * 2).alias("size"), F.col("signature2").alias("s")))
    entry = known.select("doc_id", "whole", F.explode(both).alias("e"))
    entry = entry.select("doc_id", "e.size", F.when(F.length("e.s") < GRAM, F.col("whole")).alias("short"), F.rpad("e.s", LENGTH, "\0").cast("binary").alias("sig"))
    # a distinct signature is a row, numbered once it is written; nodes of the graph are documents
    reps = entry.groupBy("size", "sig", "short").agg(F.min("doc_id").alias("doc")).withColumn("id", F.monotonically_increasing_id()).checkpoint()
    fits = (entry["size"] == reps["size"]) & (entry["sig"] == reps["sig"]) & entry["short"].eqNullSafe(reps["short"])
    same = entry.join(reps, fits).where("doc_id <> doc").select(F.col("doc_id").alias("a"), F.col("doc").alias("b"))
    long = reps.where("short is null")
    hits = shared_keys(long.select("id", "size", "sig").mapInArrow(_grams, "key bigint, id bigint"))
    pairs = forest(hits.join(long.select("id", "sig"), "id"), links, "sig")
    ids = reps.select("id", "doc")
    pairs = pairs.join(ids.withColumnsRenamed({"id": "a", "doc": "da"}), "a").join(ids.withColumnsRenamed({"id": "b", "doc": "db"}), "b")
    return components(same.unionByName(pairs.select(F.col("da").alias("a"), F.col("db").alias("b")))).select(F.col("id").alias("doc_id"), F.col("root").alias("family"))


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, block_size, signature, signature2, family) of every row of ``docs``."""
    prints = fingerprints(docs).checkpoint()
    fam = families(prints).withColumnRenamed("doc_id", "d")
    out = prints.join(fam, F.col("doc_id") == F.col("d"), "left")
    return out.select("doc_id", "block_size", "signature", "signature2", F.when(F.col("signature").isNotNull(), F.coalesce("family", "doc_id")).alias("family"))
