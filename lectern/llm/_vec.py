"""Vectorised text primitives shared by the operators of this subpackage.

Everything works on the UTF-8 bytes of a whole Arrow batch at once: a batch is one
byte array plus row offsets, and words, k-grams and hashes are numpy arrays over it.
Nothing here loops over characters or words in Python.

A *word* is a maximal run of ASCII letters, ASCII digits and non-ASCII bytes, after
Unicode lower-casing. A null text has no words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 4 << 20  # working set of one vectorised step; rows are never cut

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], U64)
_M1, _M2, _GOLD = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)


def releasing(go: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``go`` over batches, after which the worker gives freed memory back: workers live on between tasks, beside the JVM."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from go(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    h = (h ^ (h >> U64(30))) * _M1
    h = (h ^ (h >> U64(27))) * _M2
    return h ^ (h >> U64(31))


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes padded by 16 zeros, row starts, row ends) of a string or binary column; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    if n == 0:
        return np.zeros(16, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    lo, hi = offsets[0], offsets[-1]
    out = np.zeros(hi - lo + 16, np.uint8)
    if data is not None and hi > lo:
        out[:-16] = np.frombuffer(data, np.uint8)[lo:hi]
    starts, ends = offsets[:-1] - lo, offsets[1:] - lo
    if col.null_count:
        ends = np.where(np.asarray(col.is_valid()), ends, starts)
    return out, starts, ends


def slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges that hold about ``limit`` bytes each; a longer row makes a range of its own."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(col), 0), np.int64)
    part = np.cumsum(lengths) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    edges = [0, *cuts.tolist(), len(lengths)]
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        if hi > lo:
            yield lo, hi


def load8(data: np.ndarray) -> np.ndarray:
    """Unaligned little-endian 64-bit view at every byte of a padded array."""
    return np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte span [s, e); eight bytes a step, longer spans in more steps."""
    view = load8(data)
    left = e - s
    h = mix((left.astype(U64) + U64(seed)) * _GOLD)
    h = mix(h ^ (view[s] & _MASK[np.minimum(left, 8)]))
    at, todo = s, np.flatnonzero(left > 8)
    step = 8
    while len(todo):
        rest = left[todo] - step
        h[todo] = mix((h[todo] * _GOLD) ^ (view[at[todo] + step] & _MASK[np.minimum(rest, 8)]))
        step += 8
        todo = todo[rest > 8]
    return h


def word_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word starts, word ends, first word index of each row plus the total)."""
    n = len(data) - 16
    if n <= 0 or not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(starts) + 1, np.int64)
    inside = _WORD[data[: n + 1]]
    inside[n] = False
    cut = np.zeros(n + 1, bool)
    cut[starts] = True
    cut[ends] = True
    before = np.zeros(n + 1, bool)
    before[1:] = inside[:-1]
    s = np.flatnonzero(inside & (~before | cut))
    e = np.flatnonzero(before & (~inside | cut))
    return s, e, np.append(np.searchsorted(s, starts), len(s)) if len(starts) else np.zeros(1, np.int64)


def row_words(col: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word in order, first word index of each row plus the total) of a column."""
    if lower:
        col = pc.utf8_lower(col)
    data, starts, ends = column_bytes(col)
    s, e, first = word_spans(data, starts, ends)
    return (span_hashes(data, s, e) if len(s) else np.zeros(0, U64)), first


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words that begin at each word; meaningful where k words are left in the row."""
    n = len(words)
    out = np.zeros(n, U64)
    if n >= k:
        acc = np.zeros(n - k + 1, U64)
        for j in range(k):
            acc = acc * _GOLD + words[j : n - k + 1 + j]
        out[: n - k + 1] = mix(acc)
    return out


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes row by row, first shingle index of each row plus the total).

    A row of n >= k words has n - k + 1 shingles; one of 1..k-1 words has one, of all its words.
    """
    counts = np.diff(first)
    grams = gram_hashes(words, k)
    n_out = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out_first = np.concatenate([[0], np.cumsum(n_out)]).astype(np.int64)
    idx = np.arange(out_first[-1]) + np.repeat(first[:-1] - out_first[:-1], n_out)
    out = grams[idx]
    for r in np.flatnonzero((counts > 0) & (counts < k)):
        acc = U64(counts[r])
        with np.errstate(over="ignore"):
            for w in words[first[r] : first[r + 1]]:
                acc = acc * _GOLD + w
        out[out_first[r]] = mix(np.array([acc]))[0]
    return out, out_first


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of runs of equal neighbours."""
    if not len(keys):
        z = np.zeros(0, np.int64)
        return z, z
    s = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
    return s, np.append(s[1:], len(keys))


def as_i64(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as a signed number, which is what Spark stores."""
    return x.view(np.int64)
