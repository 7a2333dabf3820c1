"""Byte-level BPE encoding and decoding with a two-tier lookup.

Texts are cut into pre-tokens by the usual byte-level pattern (contractions, optional blank
plus letters, numbers or other signs, white space), here as class changes over whole batches
instead of a regular expression. Tier one: a minimal perfect hash over the vocabulary resolves
every pre-token that is itself a token, checked byte for byte. Tier two: the distinct
pre-tokens that are left are merged with a heap over linked bytes, once per worker, and kept.

The vocabulary is a file of base64 tokens and ranks whose path is a parameter; the driver reads
it and broadcasts its content (under a megabyte, whatever the input).

Defined cases: a null text has null token_ids, n_tokens and exact; an empty text has none (an
empty array) and is exact; a text may be of any length; ids outside the vocabulary decode to
nothing; a null id array decodes to null; bytes that are not valid UTF-8 decode to U+FFFD.
Rows are encoded one by one, so repeated rows, ties and empty tables need no rule, and columns
other than text are carried along or ignored as ``columns`` says.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from lectern.llm._vec import _MASK, U64, column_bytes, load8, mix, releasing, slices, span_hashes

KEPT = 500_000  # merged pre-tokens a worker keeps; beyond that it starts afresh
SLICE = 2 << 20
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of every code point: 1 letter, 2 number, 3 white space, 0 other."""
    kind = {"L": 1, "N": 2}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), np.uint8, 0x110000)
    out[_SPACES] = 3
    return out


def pre_tokens(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte starts, byte ends, first pre-token of each row plus the total); pre-tokens tile the rows."""
    n = len(data) - 16
    at = np.flatnonzero((data[:n] & 0xC0) != 0x80)
    m = len(at)
    if not m:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(starts) + 1, np.int64)
    lead = data[at]
    classes = _classes()
    cls = classes[lead]
    wide = np.flatnonzero(lead >= 0x80)
    if len(wide):
        p = at[wide]
        b0, b1, b2, b3 = (data[p + k].astype(np.int64) for k in range(4))
        cp = np.where(b0 < 0xE0, (b0 & 0x1F) << 6 | b1 & 0x3F, np.where(b0 < 0xF0, (b0 & 0x0F) << 12 | (b1 & 0x3F) << 6 | b2 & 0x3F, (b0 & 0x07) << 18 | (b1 & 0x3F) << 12 | (b2 & 0x3F) << 6 | b3 & 0x3F))
        cls[wide] = classes[np.minimum(cp, 0x10FFFF)]
    fresh = np.zeros(m + 1, bool)  # a row begins here
    row_at = np.searchsorted(at, starts[ends > starts])
    fresh[row_at] = True
    fresh[m] = True
    same = np.zeros(m, bool)
    same[1:] = (cls[1:] == cls[:-1]) & ~fresh[1:m]
    blank = lead == 32
    after_blank = np.zeros(m, bool)
    after_blank[1:] = blank[:-1] & ~fresh[1:m]
    begin = ~same & (cls != 3)  # of a run that is not white space
    start = begin & ~after_blank
    start |= ~same & (cls == 3)
    last_space = np.zeros(m, bool)  # white space before something else in its row goes with that, or alone
    last_space[:-1] = (cls[:-1] == 3) & (cls[1:] != 3) & ~fresh[1:m]
    start |= last_space
    quote = np.flatnonzero(begin & ~after_blank & (lead == 39))
    quote = quote[quote + 1 < m]
    quote = quote[~fresh[quote + 1]]
    if len(quote):
        one = lead[quote + 1]
        two = np.where((quote + 2 < m) & ~fresh[np.minimum(quote + 2, m)], lead[np.minimum(quote + 2, m - 1)], 0)
        short = np.isin(one, list(b"stmd"))
        long = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
        for hit, width in ((short, 2), (long, 3)):
            q = quote[hit]
            start[q + 1] = False
            nxt = q + width
            nxt = nxt[nxt < m]
            nxt = nxt[(cls[nxt] == 1) & ~fresh[nxt]]
            start[nxt] = True
    start |= fresh[:m]
    idx = np.flatnonzero(start)
    s = at[idx]
    e = np.append(s[1:], n)
    first = np.append(np.searchsorted(s, starts), len(s))
    return s, e, first


class PerfectHash:
    """Minimal perfect hash of 64-bit keys: a seed per bucket, or the very slot for buckets of one."""

    def __init__(self, keys: np.ndarray) -> None:
        self.n = len(keys)
        self.buckets = max(1, self.n // 3)
        bucket = (keys % U64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        ends = np.cumsum(sizes)
        self.seed = np.zeros(self.buckets, np.int64)
        taken = np.zeros(self.n, bool)
        self.slot_of_key = np.zeros(self.n, np.int64)
        tries = np.arange(1, 65)
        for b in np.argsort(-sizes, kind="stable"):
            if sizes[b] < 2:
                break
            own = order[ends[b] - sizes[b] : ends[b]]
            base = 0
            while True:
                slots = self._slot(keys[own][None, :], (base + tries)[:, None])
                free = ~taken[slots].any(1)
                if sizes[b] > 1:
                    x = np.sort(slots, 1)
                    free &= ~(x[:, 1:] == x[:, :-1]).any(1)
                if free.any():
                    k = int(free.argmax())
                    self.seed[b] = base + tries[k]
                    taken[slots[k]] = True
                    self.slot_of_key[own] = slots[k]
                    break
                base += len(tries)
        ones = np.flatnonzero(sizes == 1)
        left = np.flatnonzero(~taken)
        self.seed[ones] = -1 - left[: len(ones)]
        self.slot_of_key[order[ends[ones] - 1]] = left[: len(ones)]

    def _slot(self, h: np.ndarray, seed: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(h ^ (seed.astype(U64) * U64(0x9E3779B97F4A7C15))) % U64(self.n)).astype(np.int64)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        seed = self.seed[(h % U64(self.buckets)).astype(np.int64)]
        return np.where(seed < 0, -1 - seed, self._slot(h, np.maximum(seed, 0)))


def merge_bytes(token: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ranks of the merged pieces of one pre-token: a heap of pairs over doubly linked bytes."""
    n = len(token)
    if (whole := ranks.get(token)) is not None:
        return [whole]
    end = list(range(1, n + 1))  # end of the piece that begins here; 0 once it is merged away
    prev = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(token[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != stop:
            continue  # one of the two has changed since
        end[i], end[mid] = stop, 0
        if stop < n:
            prev[stop] = i
            if (r := ranks.get(token[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := prev[i]) >= 0 and (r := ranks.get(token[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[token[i : end[i]]])
        i = end[i]
    return out


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, raw: bytes) -> None:
        pairs = [line.split() for line in raw.splitlines() if line]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        tokens = list(self.ranks)
        blob = np.frombuffer(b"".join(tokens) + bytes(16), np.uint8)
        size = np.array([len(t) for t in tokens])
        off = np.cumsum(size) - size
        keys = span_hashes(blob, off, off + size)
        self.hash = PerfectHash(keys)
        self.blob = blob
        self.off, self.size, self.rank = (np.zeros(len(tokens), np.int64) for _ in range(3))
        slot = self.hash.slot_of_key
        self.off[slot], self.size[slot], self.rank[slot] = off, size, np.fromiter(self.ranks.values(), np.int64, len(tokens))
        top = max(self.ranks.values(), default=-1) + 1
        self.byte_off, self.byte_size = np.zeros(top, np.int64), np.zeros(top, np.int64)
        self.byte_off[self.rank], self.byte_size[self.rank] = self.off, self.size
        self._forget()

    def _forget(self) -> None:
        self.seen, self.seen_at, self.seen_n, self.flat = np.zeros(0, U64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.seen_check = np.zeros(0, U64)

    def _known(self, data: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Rank of each span that is a token, -1 for the others."""
        slot = self.hash(h)
        size = e - s
        ok = self.size[slot] == size
        mine, theirs = load8(data), load8(self.blob)
        todo, step = np.flatnonzero(ok), 0
        while len(todo):
            mask = _MASK[np.minimum(size[todo] - step, 8)]
            same = (mine[s[todo] + step] & mask) == (theirs[self.off[slot[todo]] + step] & mask)
            ok[todo[~same]] = False
            step += 8
            todo = todo[same & (size[todo] > step)]
        return np.where(ok, self.rank[slot], -1)

    def _merged(self, data: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``flat``, number of ids) of spans that are no tokens."""
        uniq, one, back = np.unique(h, return_index=True, return_inverse=True)
        check = span_hashes(data, s, e, 0x5EED)
        at = np.searchsorted(self.seen, uniq)
        have = (at < len(self.seen)) & (self.seen[np.minimum(at, max(len(self.seen) - 1, 0))] == uniq) if len(self.seen) else np.zeros(len(uniq), bool)
        new = np.flatnonzero(~have)
        if len(new):
            if len(self.seen) + len(new) > KEPT:
                self._forget()
                new = np.arange(len(uniq))
            raw = data.tobytes()
            ids = [merge_bytes(raw[s[k] : e[k]], self.ranks) for k in one[new]]
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            begin = len(self.flat) + np.cumsum(n) - n
            self.flat = np.concatenate([self.flat, np.fromiter((x for t in ids for x in t), np.int32, int(n.sum()))])
            place = np.searchsorted(self.seen, uniq[new])
            self.seen = np.insert(self.seen, place, uniq[new])
            self.seen_at = np.insert(self.seen_at, place, begin)
            self.seen_n = np.insert(self.seen_n, place, n)
            self.seen_check = np.insert(self.seen_check, place, check[one[new]])
            at = np.searchsorted(self.seen, uniq)
        place, n = self.seen_at[at][back].astype(np.int64), self.seen_n[at][back].astype(np.int64)
        other = np.flatnonzero(self.seen_check[at][back] != check)  # equal names, other bytes: merged one by one
        for k in other.tolist():
            ids = np.array(merge_bytes(data[s[k] : e[k]].tobytes(), self.ranks), np.int32)
            place[k], n[k] = len(self.flat), len(ids)
            self.flat = np.concatenate([self.flat, ids])
        return place, n

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first id of each row plus the total)."""
        s, e, first = pre_tokens(data, starts, ends)
        if not len(s):
            return np.zeros(0, np.int32), first
        h = span_hashes(data, s, e)
        rank = self._known(data, s, e, h)
        count = np.ones(len(s), np.int64)
        miss = np.flatnonzero(rank < 0)
        if len(miss):
            place, n = self._merged(data, s[miss], e[miss], h[miss])
            count[miss] = n
        to = np.cumsum(count)
        out = np.empty(to[-1], np.int32)
        hit = rank >= 0
        out[to[hit] - 1] = rank[hit]
        if len(miss):
            rep = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(to[miss] - n, n) + rep] = self.flat[np.repeat(place, n) + rep]
        return out, np.concatenate([[0], to])[first]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, first byte of each row plus the total)."""
        ok = (ids >= 0) & (ids < len(self.byte_size))
        ids = np.where(ok, ids, 0)
        n = np.where(ok, self.byte_size[ids], 0)
        to = np.cumsum(n)
        total = int(to[-1]) if len(to) else 0
        src = np.arange(total) + np.repeat(self.byte_off[ids] - (to - n), n)
        return self.blob[src], np.concatenate([[0], to])[first]


@lru_cache(2)
def codec(raw: bytes) -> Codec:
    return Codec(raw)


def _vocabulary(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, vocabulary: str, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` of ``docs`` with token_ids, n_tokens and exact (decoding gives the very text again)."""
    raw = _vocabulary(docs, vocabulary)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(raw.value)
        for b in batches:
            col = b.column("__text")
            for lo, hi in slices(col, SLICE):
                part = col.slice(lo, hi - lo)
                data, s, e = column_bytes(part)
                ids, first = own.encode(data, s, e)
                back, at = own.decode(ids, first)
                body = data[:-16]
                if len(back) == len(body) and np.array_equal(back, body):
                    exact = at[:-1] == s
                else:
                    exact = np.array([np.array_equal(back[at[k] : at[k + 1]], body[s[k] : e[k]]) for k in range(hi - lo)])
                gone = np.asarray(part.is_null())
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids), mask=pa.array(gone)) if hi > lo else pa.array([], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(lo, hi - lo) for c in columns), lists, pa.array(np.diff(first), mask=gone), pa.array(exact, mask=gone)], [*columns, "token_ids", "n_tokens", "exact"])

    chosen = docs.select(*columns, docs["text"].cast("string").alias("__text"))
    schema = StructType([*(chosen.schema[c] for c in columns), StructField("token_ids", ArrayType(IntegerType())), StructField("n_tokens", LongType()), StructField("exact", BooleanType())])
    return chosen.mapInArrow(releasing(go), schema)


def count(docs: DataFrame, vocabulary: str, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` of ``docs`` with n_tokens; no ids are kept."""
    raw = _vocabulary(docs, vocabulary)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(raw.value)
        for b in batches:
            col = b.column("__text")
            for lo, hi in slices(col, SLICE):
                part = col.slice(lo, hi - lo)
                _, first = own.encode(*column_bytes(part))
                n = pa.array(np.diff(first).astype(np.int64), mask=np.asarray(part.is_null()))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(lo, hi - lo) for c in columns), n], [*columns, "n_tokens"])

    chosen = docs.select(*columns, docs["text"].cast("string").alias("__text"))
    return chosen.mapInArrow(releasing(go), StructType([*(chosen.schema[c] for c in columns), StructField("n_tokens", LongType())]))


def decode(tokens: DataFrame, vocabulary: str, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` of ``tokens`` with the text of token_ids."""
    raw = _vocabulary(tokens, vocabulary)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(raw.value)
        for b in batches:
            ids = b.column("token_ids")
            n = np.asarray(pc.fill_null(pc.list_value_length(ids), 0), np.int64)
            flat = np.asarray(pc.fill_null(pc.list_flatten(ids), -1), np.int64)
            out, at = own.decode(flat, np.concatenate([[0], np.cumsum(n)]))
            raw_out = out.tobytes()
            text = [None if not v else raw_out[at[k] : at[k + 1]].decode("utf-8", "replace") for k, v in enumerate(ids.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(text, pa.string())], [*columns, "text"])

    chosen = tokens.select(*columns, "token_ids")
    return chosen.mapInArrow(releasing(go), StructType([*(chosen.schema[c] for c in columns), StructField("text", StringType())]))


__all__: list[str] = ["Codec", "PerfectHash", "decode", "encode", "merge_bytes", "pre_tokens"]
