"""Exact repeated passages: per-shard suffix arrays, merged across shards.

A passage is a run of at least ``MIN_WORDS`` words that also occurs in another document. The
result is the union of all windows of ``MIN_WORDS`` words that two documents share. Words are
compared by 64-bit hashes, windows of different shards by 128 bits.

1. *Candidates.* Each window of ``MIN_WORDS`` words is named by the least hash of its
   ``GRAM``-word grams. Equal windows have equal names, so windows whose name no second
   document has are dropped without loss; about one name in eighteen words is shuffled.
2. *Shards.* The segments of candidate windows are cut out where a text meets its shared names, and
   only they travel on. They are laid out by their document's least shared name, so that copies
   meet in one shard; a shard is about ``SHARD_WORDS`` words, and a name with more than that is spread
   over several. Names that documents of more than one shard have are marked as crossing.
3. *Suffix array* of each shard's segments by Larsson-Sadakane refinement in numpy: only groups not
   yet told apart are sorted again, by the rank ``h`` words on, h doubling.
4. *Kasai.* Common prefixes of neighbours. The recurrence plcp[i] >= plcp[i-1] - 1 holds with
   equality wherever the words before both suffixes agree, so only the other positions are
   compared word by word, all of them at once.
5. *Merge.* Runs of suffixes with common prefixes of ``MIN_WORDS`` words that two documents
   share are settled inside the shard. Of the other runs with crossing names each shard sends its
   windows, and of the settled ones a witness, as a run sorted by the window's hash, cut into hash
   ranges. Where a range's runs meet, every shard's run is looked up in the others' by binary search.

``drop_repeated`` removes what ``repeated_passages`` finds, but for the first occurrence.

Defined cases: a null text, or one of fewer than ``MIN_WORDS`` words, has no passages; a text of any
length is taken whole; a null doc_id takes no part (its row stays as it is); rows that repeat a doc_id
are one document, so they don't repeat each other; ``across=False`` also counts repeats inside one
document. Every occurrence is reported, the first too. Ties can't arise. An empty table gives an empty
result; columns but doc_id and text aren't read, and ``drop_repeated`` passes them on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm._graph import _by_key
from lectern.llm._small import free
from lectern.llm._vec import U64, as_i64, column_bytes, gram_hashes, mix, runs, slices, span_hashes, word_spans

MIN_WORDS, GRAM, SHARD_WORDS = 50, 16, 1_500_000
SPANS = "doc_id bigint, w0 bigint, w1 bigint, c0 bigint, c1 bigint"
RECORDS = "key bigint, check bigint, shard bigint, id bigint, many boolean, settled boolean, w0 bigint, w1 bigint, c0 bigint, c1 bigint"
SEGMENTS = "place bigint, salt bigint, doc_id bigint, w0 bigint, c0 bigint, text string, cross array<bigint>"
_RECORD = [x.split()[0] for x in RECORDS.split(", ")]


def window_keys(words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the window that begins at each word."""
    return gram_hashes(words, length), gram_hashes(mix(words ^ U64(0xD6E8FEB86659FD93)), length)


def _slide(x: np.ndarray, w: int, op: Callable) -> np.ndarray:
    """op over [i, i + w) for every i, in log2(w) passes; the last w - 1 places see a shorter window."""
    out, span = x.copy(), 1
    while span < w:
        step = min(span, w - span)
        out[:-step] = op(out[:-step], out[step:]) if len(out) > step else out[:-step]
        span += step
    return out


def window_names(words: np.ndarray, first: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(name of the window that begins at each word, mask of the words where one begins)."""
    ok = np.zeros(len(words), bool)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(words))
    ok[:] = left >= length
    if not ok.any():
        return np.zeros(len(words), U64), ok
    return _slide(gram_hashes(words, gram), length - gram + 1, np.minimum), ok


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank of each suffix) of an integer sequence by Larsson-Sadakane refinement."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sa = np.argsort(text, kind="stable")
    s, e = runs(text[sa])
    rank = np.empty(n, np.int64)
    rank[sa] = np.repeat(e - 1, e - s)  # a group is ranked by its last place
    open_ = e - s > 1
    places = np.repeat(s[open_], (e - s)[open_]) + _within((e - s)[open_])
    h = 1
    while len(places):
        suf = sa[places]
        group = rank[suf]
        ahead = np.where(suf + h < n, rank[np.minimum(suf + h, n - 1)] + 1, 0)
        order = np.lexsort((ahead, group)) if n >= 1 << 31 else np.argsort(group * (n + 1) + ahead, kind="stable")
        suf, group, ahead = suf[order], group[order], ahead[order]
        sa[places] = suf
        s, e = runs(group * (n + 1) + ahead)
        size = e - s
        rank[suf] = np.repeat(places[e - 1], size)
        places = places[np.repeat(size > 1, size)]
        h *= 2
    return sa, rank


def _within(sizes: np.ndarray) -> np.ndarray:
    """0..size-1 for each size."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    return np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)


def kasai(text: np.ndarray, sa: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """lcp[r]: words that the suffixes at places r - 1 and r have in common; lcp[0] = 0."""
    n = len(text)
    if n < 2:
        return np.zeros(n, np.int64)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    i = np.arange(n)
    chained = np.zeros(n, bool)  # Kasai's step loses exactly one word there
    chained[1:] = (phi[1:] > 0) & (phi[:-1] >= 0) & (text[np.maximum(phi[1:] - 1, 0)] == text[:-1])
    todo = np.flatnonzero(~chained & (phi >= 0))
    plcp = np.zeros(n, np.int64)
    padded = np.append(text, np.arange(-1, -65, -1))
    step = np.arange(8)
    while len(todo):
        a, b = todo + plcp[todo], phi[todo] + plcp[todo]
        same = (padded[a[:, None] + step] == padded[b[:, None] + step]) & ((np.maximum(a, b)[:, None] + step) < n)
        got = np.where(same.all(1), 8, same.argmin(1))
        plcp[todo] += got
        todo = todo[got == 8]
    origin = np.maximum.accumulate(np.where(chained, 0, i))
    plcp = np.where(chained, plcp[origin] - (i - origin), plcp)
    lcp = np.zeros(n, np.int64)
    lcp[1:] = plcp[sa[1:]]
    return lcp


def _names(length: int, gram: int) -> Callable:
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            for lo, hi in slices(b.column("text")):
                data, s, e = column_bytes(pc.utf8_lower(b.column("text").slice(lo, hi - lo)))
                ws, we, first = word_spans(data, s, e)
                names, ok = window_names(span_hashes(data, ws, we) if len(ws) else np.zeros(0, U64), first, length, gram)
                row = np.repeat(np.arange(lo, hi), np.diff(first))[ok]
                key = names[ok]
                if len(key):
                    new = np.ones(len(key), bool)  # neighbouring windows mostly share their name
                    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
                    yield pa.RecordBatch.from_arrays([pa.array(as_i64(key[new])), pa.array(ids[row[new]])], ["key", "id"])

    return go


def _held_twice(across: bool) -> Callable:
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_key(batches):
            key, ids = t["key"].to_numpy(), t["id"].to_numpy()
            s, e = runs(key)
            if across:
                hot = np.minimum.reduceat(ids, s) != np.maximum.reduceat(ids, s)
            else:
                hot = np.ones(len(s), bool)  # a document may repeat itself under one name
            keep = np.repeat(hot, e - s)
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(ids[keep])], ["key", "id"])

    return go


class _Shard:
    """Candidate segments of some documents, side by side, each behind a word of its own."""

    def __init__(self) -> None:
        self.size = 0
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, doc: int, words: np.ndarray, at: np.ndarray, c0: np.ndarray, c1: np.ndarray, cross: np.ndarray) -> None:
        self.parts.append((words, np.full(len(words), doc), at, c0, c1, cross))
        self.size += len(words) + 1

    def records(self, length: int, across: bool) -> pa.RecordBatch | None:
        if not self.parts:
            return None
        words = np.concatenate([p[0] for p in self.parts])
        doc, at, c0, c1, cross = (np.concatenate([p[k] for p in self.parts]) for k in range(1, 6))
        sizes = np.array([len(p[0]) for p in self.parts])
        ends = np.cumsum(sizes)
        left = np.repeat(ends, sizes) - np.arange(len(words))
        _, code = np.unique(words, return_inverse=True)
        where = np.arange(len(words)) + np.repeat(np.arange(len(sizes)), sizes)
        text = np.empty(len(words) + len(sizes), np.int64)
        text[ends + np.arange(len(sizes))] = -1 - np.arange(len(sizes))  # separators differ, so no match crosses them
        text[where] = code
        back = np.full(len(text), -1, np.int64)
        back[where] = np.arange(len(words))
        sa, rank = suffix_array(text)
        lcp = kasai(text, sa, rank)
        own = back[sa]
        fits = (own >= 0) & (left[np.maximum(own, 0)] >= length)
        label = np.cumsum(lcp < length)
        own, label = own[fits], label[fits]
        if not len(own):
            return None
        s, e = runs(label)
        d = doc[own]
        twice = (np.minimum.reduceat(d, s) != np.maximum.reduceat(d, s)) if across else (e - s > 1)
        key, check = window_keys(words, length)
        name = int(mix(np.array([words[0] ^ U64(len(words)), words[-1] ^ U64(int(doc[0]) & (1 << 63) - 1)], U64)).view(np.int64).sum())  # whose run it is
        settled = np.repeat(twice, e - s)
        # settled suffixes become intervals of neighbouring windows; the others travel by window hash
        hit = np.sort(own[settled])
        out = []

        def put(k: np.ndarray, c: np.ndarray, ids: np.ndarray, many: bool, done: bool, *place: np.ndarray) -> None:
            n = len(ids)
            out.append((k, c, np.full(n, name), ids, np.full(n, many), np.full(n, done), *place))

        if len(hit):
            gap = np.ones(len(hit), bool)
            gap[1:] = (hit[1:] != hit[:-1] + 1) | (at[hit[1:]] != at[hit[:-1]] + 1) | (doc[hit[1:]] != doc[hit[:-1]])
            b = np.flatnonzero(gap)
            last = np.append(b[1:], len(hit)) - 1
            p, q = hit[b], hit[last] + length - 1
            zero = np.zeros(len(p), np.int64)
            put(zero, zero, doc[p], False, True, at[p], at[q] + 1, c0[p], c1[q])
        p = own[s[twice]]
        p = p[cross[p]]
        z = np.zeros(len(p), np.int64)
        put(as_i64(key[p]), as_i64(check[p]), doc[p], True, False, z, z, z, z)
        p = own[~settled & cross[own]]
        put(as_i64(key[p]), as_i64(check[p]), doc[p], False, False, at[p], at[p] + length, c0[p], c1[p + length - 1])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], _RECORD)


def _cut(length: int, gram: int) -> Callable:
    """The candidate segments of texts (doc_id, text, hot, cross, place, salt), lower-cased, each with the number of its first word and character and its crossing names."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hot, crossing, place, salt = (b.column(c) for c in ("doc_id", "hot", "cross", "place", "salt"))
            for lo, hi in slices(b.column("text")):
                data, s, e = column_bytes(pc.utf8_lower(b.column("text").slice(lo, hi - lo)))
                ws, we, first = word_spans(data, s, e)
                words = span_hashes(data, ws, we) if len(ws) else np.zeros(0, U64)
                names, ok = window_names(words, first, length, gram)
                chars = np.cumsum((data & 0xC0) != 0x80) - 1  # index of the character at each byte, over the slice
                rows, w0, c0, text, cross, raw = [], [], [], [], [], data.tobytes()
                for r in range(lo, hi):
                    f, g = first[r - lo], first[r - lo + 1]
                    cand = np.flatnonzero(ok[f:g] & np.isin(as_i64(names[f:g]), hot[r].values.to_numpy()))
                    for seg in np.split(cand, np.flatnonzero(np.diff(cand) > length) + 1) if len(cand) else ():
                        p, q = f + seg[0], f + seg[-1] + length - 1
                        rows.append(r)
                        w0.append(p - f)
                        c0.append(chars[ws[p]] - chars[s[r - lo]])
                        text.append(raw[ws[p] : we[q]].decode())
                        cross.append(np.intersect1d(as_i64(names[f + seg]), crossing[r].values.to_numpy()).tolist())
                pick = pa.array(rows, pa.int64())
                cols = [place.take(pick), salt.take(pick), ids.take(pick), pa.array(w0, pa.int64()), pa.array(c0, pa.int64()), pa.array(text, pa.string()), pa.array(cross, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, ["place", "salt", "doc_id", "w0", "c0", "text", "cross"])

    return go


def _shards(length: int, gram: int, across: bool, shard_words: int) -> Callable:
    """Records of segments sorted by place and salt; a shard ends where these change, so that all of a place and salt are in one."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, last = _Shard(), None
        for b in batches:
            ids, w0, c0 = (b.column(c).to_numpy() for c in ("doc_id", "w0", "c0"))
            where = list(zip(b.column("place").to_pylist(), b.column("salt").to_pylist(), strict=True))
            for lo, hi in slices(b.column("text")):
                data, s, e = column_bytes(b.column("text").slice(lo, hi - lo))
                ws, we, first = word_spans(data, s, e)
                words = span_hashes(data, ws, we) if len(ws) else np.zeros(0, U64)
                names, _ = window_names(words, first, length, gram)
                chars = np.cumsum((data & 0xC0) != 0x80) - 1
                for r in range(lo, hi):
                    if shard.size >= shard_words and where[r] != last:
                        if (out := shard.records(length, across)) is not None:
                            yield out
                        shard = _Shard()
                    last = where[r]
                    f, g = first[r - lo], first[r - lo + 1]
                    base = c0[r] - chars[s[r - lo]]
                    cross = np.isin(as_i64(names[f:g]), b.column("cross")[r].values.to_numpy())
                    shard.add(ids[r], words[f:g], w0[r] + np.arange(g - f), chars[ws[f:g]] + base, chars[we[f:g] - 1] + 1 + base, cross)
        if (out := shard.records(length, across)) is not None:
            yield out

    return go


def _met(name: np.ndarray, shard: np.ndarray, ids: np.ndarray, many: np.ndarray, across: bool) -> np.ndarray:
    """Which rows, sorted by name, meet another document's row of the same name (``across=False``: another row): every shard's sorted run is looked up in the others' by binary search."""
    hit = np.zeros(len(name), bool)
    order = np.argsort(shard, kind="stable")  # each shard's run stays sorted
    s, e = runs(shard[order])
    for a, b in zip(s.tolist(), e.tolist(), strict=True):
        one = order[a:b]
        lo, hi = np.searchsorted(name, name[one], "left"), np.searchsorted(name, name[one], "right")
        cuts = np.stack([lo, hi], 1).ravel()
        witness = np.logical_or.reduceat(np.append(many, False), cuts)[::2]
        if across:
            least, most = (op.reduceat(np.append(ids, 0), cuts)[::2] for op in (np.minimum, np.maximum))
            hit[one] = witness | (least != ids[one]) | (most != ids[one])
        else:
            hit[one] = witness | (hi - lo > 1)
    return hit


def _merge(across: bool) -> Callable:
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_key(batches):
            key, check, shard, ids, many = (t[c].to_numpy() for c in ("key", "check", "shard", "id", "many"))
            order = np.lexsort((check, key))
            new = np.append(True, (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1]))
            name = np.empty(len(key), np.int64)
            name[order] = np.cumsum(new) - 1
            s, e = runs(name[order])
            alone = np.repeat(e - s == 1, e - s)  # most windows meet nobody
            look = order[~alone]
            keep = np.zeros(len(key), bool)
            if len(look):
                keep[look] = _met(name[look], shard[look], ids[look], many[look], across) & ~many[look]
            out = t.select(["id", "w0", "w1", "c0", "c1"]).filter(pa.array(keep)).rename_columns(["doc_id", "w0", "w1", "c0", "c1"])
            yield from out.combine_chunks().to_batches()

    return go


def _occurrences(docs: DataFrame, min_words: int, gram: int, across: bool, shard_words: int) -> DataFrame:
    """(doc_id, w0, w1, c0, c1): intervals whose windows are all repeated."""
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    names = text.mapInArrow(_names(min_words, gram), "key bigint, id bigint")
    hot = names.repartition("key").sortWithinPartitions("key").mapInArrow(_held_twice(across), "key bigint, id bigint")
    hot = hot.groupBy("id").agg(F.collect_set("key").alias("hot"), F.min("key").alias("place")).checkpoint()
    words = F.sum(F.size("hot") * F.lit((min_words - gram + 2) / 2) + min_words)  # about as many as its names stand for
    crowd = hot.groupBy("place").agg(F.ceil(words / F.lit(shard_words)).alias("split"))
    placed = hot.join(crowd, "place").withColumn("salt", F.expr("cast(pmod(hash(id), split) as bigint)")).drop("split")
    pairs = placed.select("id", F.explode("hot").alias("key"), F.struct("place", "salt").alias("at"))
    cross = pairs.groupBy("key").agg(F.min("at").alias("a"), F.max("at").alias("b")).where("a <> b").select("key")
    cross = pairs.join(cross, "key").groupBy(F.col("id").alias("doc")).agg(F.collect_list("key").alias("cross"))
    placed = placed.join(cross, F.col("id") == F.col("doc"), "left").withColumn("cross", F.coalesce("cross", F.array().cast("array<bigint>")))
    cut = text.join(placed, F.col("doc_id") == F.col("id")).select("doc_id", "text", "hot", "cross", "place", "salt").mapInArrow(_cut(min_words, gram), SEGMENTS)
    records = cut.repartition("place", "salt").sortWithinPartitions("place", "salt").mapInArrow(_shards(min_words, gram, across, shard_words), RECORDS).checkpoint()
    settled = records.where("settled").select(F.col("id").alias("doc_id"), "w0", "w1", "c0", "c1")
    merged = records.where("not settled").repartition("key").sortWithinPartitions("key").mapInArrow(_merge(across), SPANS)
    return settled.unionByName(merged)


def _united(spans: DataFrame) -> DataFrame:
    """(doc_id, w0, w1, c0, c1) of the unions of overlapping or touching intervals."""
    w = Window.partitionBy("doc_id").orderBy("w0", "w1")
    before = F.coalesce(F.max("w1").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    spans = spans.withColumn("new", (F.col("w0") > before).cast("int"))
    spans = spans.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy("doc_id", "island").agg(F.min("w0").alias("w0"), F.max("w1").alias("w1"), F.min("c0").alias("c0"), F.max("c1").alias("c1")).drop("island")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM, across: bool = True, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, start_char, end_char, start_word, n_words): the maximal unions of repeated windows, in characters of the text."""
    out = _united(_occurrences(docs, min_words, gram, across, shard_words))
    return out.select("doc_id", F.col("c0").alias("start_char"), F.col("c1").alias("end_char"), F.col("w0").alias("start_word"), (F.col("w1") - F.col("w0")).alias("n_words"))


def _windows(length: int) -> Callable:
    """(key, check, doc_id, w0, w1, c0, c1) of every window inside the passages of texts (doc_id, text, spans)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, spans = b.column("doc_id").to_numpy(), b.column("spans")
            for lo, hi in slices(b.column("text")):
                data, s, e = column_bytes(pc.utf8_lower(b.column("text").slice(lo, hi - lo)))
                ws, we, first = word_spans(data, s, e)
                key, check = window_keys(span_hashes(data, ws, we) if len(ws) else np.zeros(0, U64), length)
                chars = np.cumsum((data & 0xC0) != 0x80) - 1
                for r in range(lo, hi):
                    f, base = first[r - lo], chars[s[r - lo]] if len(ws) else 0
                    w0 = np.concatenate([np.arange(x["start_word"], x["start_word"] + x["n_words"] - length + 1) for x in spans[r].as_py()])
                    p = f + w0
                    cols = (as_i64(key[p]), as_i64(check[p]), np.full(len(p), ids[r]), w0, w0 + length, chars[ws[p]] - base, chars[we[p + length - 1] - 1] + 1 - base)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["key", "check", "doc_id", "w0", "w1", "c0", "c1"])

    return go


def drop_repeated(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` without repeated passages: of equal windows the first (by doc_id, then by place) stays, the others' words are cut out.

    What is cut takes the characters up to its last word with it; an n_chars column that held the length is
    renewed. Rows that repeat a doc_id keep their texts, since it is unknown which of them a place is in.
    """
    again = docs.groupBy(F.col("doc_id").cast("bigint").alias("d")).agg(F.count("*").alias("n")).where("n > 1").select("d").checkpoint()
    spans = repeated_passages(docs, min_words, gram, True, shard_words).join(again, F.col("doc_id") == F.col("d"), "left_anti")
    spans = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_word", "n_words"))).alias("spans"))
    held = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(spans, "doc_id")
    windows = held.mapInArrow(_windows(min_words), "key bigint, check bigint, " + SPANS).checkpoint()
    first = windows.groupBy("key", "check").agg(F.min(F.struct("doc_id", "w0")).alias("first"))
    gone = _united(windows.join(first, ["key", "check"]).where("struct(doc_id, w0) <> first").select("doc_id", "w0", "w1", "c0", "c1"))
    mine, cuts = free("cut_id", docs.columns), free("cuts", docs.columns)
    gone = gone.groupBy(F.col("doc_id").alias(mine)).agg(F.array_sort(F.collect_list(F.struct("c0", "c1"))).alias(cuts))
    both = docs.join(gone, docs["doc_id"].cast("bigint") == F.col(mine), "left")
    start = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(cuts, lambda c: c["c1"]))
    stop = F.concat(F.transform(cuts, lambda c: c["c0"]), F.array(F.length("text").cast("bigint")))
    kept = F.array_join(F.transform(F.arrays_zip(start.alias("a"), stop.alias("b")), lambda p: F.substring(docs["text"], (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int"))), "")
    changed = F.when(F.col(cuts).isNull(), docs["text"]).otherwise(kept)
    columns = [changed.alias(c) if c == "text" else F.when((docs[c] == F.length(docs["text"])) & F.col(cuts).isNotNull(), F.length(kept)).otherwise(docs[c]).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else docs[c] for c in docs.columns]
    return both.select(*columns)
