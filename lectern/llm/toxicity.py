"""Toxicity by a counterfactually regularised classifier.

A logistic model over the words of a sentence and their beginnings (3 to 8 bytes, so that inflected
forms count together) is trained on the sentences of labelled documents. Every sentence that holds
an identity term is also swapped: the term is replaced, wherever it stands in the sentence, by each
other term of its group, the features of the swapped sentence are taken anew, and the squared change
of the score is penalised, averaged over the other terms. The penalty pulls the scores of a group's
terms together and, with the ridge term, towards what the rest of the sentence does not explain, so
naming a group is no evidence by itself. ``IDENTITY_GROUPS`` (English, German, French, Spanish) is the
default of a parameter.

A document's labels don't say which of its sentences they are for, and in a long document some word
looks like a toxic one by chance. So a second logistic model, of three numbers (the log-odds of the
most and of the second most toxic sentence, and the logarithm of the number of sentences), fitted on
the same labelled documents, turns sentence scores into the document's.

``MAX_LABELLED`` bounds the labelled documents the model is fitted on (a hash sample of the
labelled ids) and ``MAX_SENTENCE_BYTES`` their sentences (a hash sample too, where there are more);
everything else reads all rows. Equal sentences are one training row with their
mean label. Labels are noisy and belong to documents, so a feature enters the model only if its
sentences' labels stray from the mean by ``MIN_Z`` standard deviations, with documents as the
units of chance (a word of one long toxic document proves little); identity terms always enter, and
a beginning brings along the word that equals it, so that a stem alone is told from its forms.

Defined cases: a null, empty or wordless text scores 0 and is not toxic; the filter keeps it; a text of
any length is scored whole; a score at the threshold is toxic. A null label or doc_id in ``labels`` is ignored; several labels of a document count as their
maximum. Without at least one label of each class every score is 0. Rows are scored one by one,
so repeated rows get equal scores; an empty table gives an empty result; only text is read, and
the filter passes all other columns through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm._vec import _MASK, U64, column_bytes, load8, mix, releasing, slices, span_hashes, word_spans

MAX_LABELLED, MIN_Z, THRESHOLD, PREFIXES = 4000, 7.0, 0.5, range(3, 9)
RIDGE, SWAP_PENALTY, ROUNDS = 1.0, 50.0, 150
MAX_SENTENCE_BYTES = 64 << 20
_GROUPS = """women men girls boys / woman man girl boy / muslim christian jewish hindu buddhist atheist
muslims christians jews hindus buddhists atheists / black white asian latino african european / gay straight lesbian bisexual queer transgender
immigrant native refugee foreigner / immigrants natives refugees foreigners / old young elderly / disabled deaf blind autistic
frauen männer mädchen jungen / frau mann / muslime christen juden hindus buddhisten atheisten / muslimisch christlich jüdisch hinduistisch buddhistisch
muslimische christliche jüdische hinduistische buddhistische / schwarze weiße asiaten afrikaner europäer / schwul lesbisch hetero bisexuell queer trans
schwule lesben heteros bisexuelle / ausländer einheimische flüchtlinge migranten / alte junge senioren / behinderte gehörlose blinde autisten
femmes hommes filles garçons / femme homme fille garçon / musulmans chrétiens juifs hindous bouddhistes athées / musulman chrétien juif hindou bouddhiste athée
noirs blancs asiatiques africains européens / noir blanc asiatique africain européen / gays lesbiennes hétéros bisexuels / immigrés réfugiés étrangers migrants
vieux jeunes âgés / handicapés sourds aveugles autistes
mujeres hombres niñas niños / mujer hombre niña niño / musulmanes cristianos judíos hindúes budistas ateos / musulmán cristiano judío hindú budista ateo
negros blancos asiáticos africanos europeos / negro blanco asiático africano europeo / gais lesbianas heteros bisexuales
inmigrantes refugiados extranjeros nativos / viejos jóvenes ancianos / discapacitados sordos ciegos autistas"""
IDENTITY_GROUPS: tuple[tuple[str, ...], ...] = tuple(tuple(g.split()) for line in _GROUPS.splitlines() for g in line.split("/"))
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n\r;")] = True


def features(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) pairs of word spans: the word itself and its beginnings."""
    view, size = load8(data), e - s
    word, feat = [np.arange(len(s))], [span_hashes(data, s, e)]
    for k in PREFIXES:
        i = np.flatnonzero(size >= k)
        word.append(i)
        feat.append(mix((view[s[i]] & _MASK[k]) * U64(2) + U64(k * 0xA24BAED4963EE407 % (1 << 64))))
    return np.concatenate(word), np.concatenate(feat)


def _beginnings(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """First three bytes of each word as a number."""
    return (load8(data)[s] & _MASK[np.minimum(e - s, 3)]).astype(np.int64)


def sentences(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, word starts, word ends, sentence of each word, row of each sentence)."""
    data, starts, ends = column_bytes(pc.utf8_lower(col))
    s, e, first = word_spans(data, starts, ends)
    stops = np.cumsum(_STOP[data])
    row = np.repeat(np.arange(len(col)), np.diff(first))
    new = np.ones(len(s), bool)
    new[1:] = (row[1:] != row[:-1]) | (stops[s[1:]] != stops[s[:-1]])
    return data, s, e, np.cumsum(new) - 1, row[new]


@dataclass
class Model:
    """Weights by feature, in the order of the features, and the bias."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    begins: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # first bytes of words worth a look
    bias: float = -np.inf
    whole: np.ndarray | None = None  # of documents: constant, first, second, sentences

    def __post_init__(self) -> None:
        self.look: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"look": None}

    def evidence(self, col: pa.Array) -> np.ndarray:
        """(log-odds of the most and the second most toxic sentence, sentences) of each row with words; NaN without."""
        data, s, e, sent, row = sentences(col)
        out = np.full((len(col), 3), np.nan)
        if not len(row) or not np.isfinite(self.bias):
            return out
        if self.look is None:
            self.look = np.zeros(1 << 24, bool)
            self.look[self.begins] = True
        at = np.flatnonzero(self.look[_beginnings(data, s, e)])
        word, feat = features(data, s[at], e[at])
        place = np.minimum(np.searchsorted(self.keys, feat), len(self.keys) - 1)
        hit = self.keys[place] == feat if len(self.keys) else np.zeros(len(feat), bool)
        pair = np.unique(sent[at[word[hit]]] * len(self.keys) + place[hit])
        z = np.full(len(row), self.bias)
        if len(pair):
            z += np.bincount(pair // len(self.keys), weights=self.weights[pair % len(self.keys)], minlength=len(row))
        order = np.lexsort((-z, row))
        z, row = z[order], row[order]
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        count = np.diff(np.append(first, len(row)))
        second = np.where(count > 1, z[np.minimum(first + 1, len(z) - 1)], self.bias)
        out[row[first]] = np.stack([z[first], second, count], 1)
        return out

    def score(self, col: pa.Array) -> np.ndarray:
        """Score of each row; 0 without words."""
        x = self.evidence(col)
        z = x[:, 0] if self.whole is None else _inputs(x) @ self.whole
        return np.where(np.isnan(x[:, 0]), 0.0, 1 / (1 + np.exp(np.clip(-np.nan_to_num(z), -500, 500))))


def _inputs(x: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(x)), x[:, 0], x[:, 1], np.log(x[:, 2])], 1)


def calibrate(model: Model, x: np.ndarray, label: np.ndarray) -> Model:
    """``model`` with the document model fitted on the evidence of labelled documents; unchanged if that has one class only."""
    ok = ~np.isnan(x[:, 0])
    x, label = _inputs(x[ok]), label[ok]
    if len(label) and 0 < label.mean() < 1:
        use = np.ones(4, bool)
        while True:
            w = np.zeros(use.sum())
            for _ in range(30):  # Newton's method
                p = 1 / (1 + np.exp(np.clip(-(x[:, use] @ w), -30, 30)))
                grad = x[:, use].T @ (p - label) + 1e-2 * w
                w -= np.linalg.solve((x[:, use] * (p * (1 - p))[:, None]).T @ x[:, use] + 1e-2 * np.eye(len(w)), grad)
            model.whole = np.zeros(4)
            model.whole[use] = w
            wrong = (model.whole[1:3] < 0) & use[1:3]  # more evidence never speaks for a document
            if not wrong.any():
                break
            use[1:3] &= ~wrong
    return model


class Swaps(NamedTuple):
    """Changes of the features by swapping terms: entry k says that change ``row[k]`` adds (1) or takes (-1) ``feature[k]``; ``times`` weighs each change."""

    row: np.ndarray
    feature: np.ndarray
    sign: np.ndarray
    times: np.ndarray


def _swaps(parts: list[tuple], groups: tuple[tuple[str, ...], ...], keys: np.ndarray) -> Swaps:
    """The changes that swapped sentences make. Sentences that stand alike to a group's features have one change."""
    data, ts, te = column_bytes(pc.utf8_lower(pa.array([x for g in groups for x in g], pa.string())))
    names = span_hashes(data, ts, te) if len(ts) else np.zeros(0, U64)
    word, feat = features(data, ts, te) if len(ts) else (np.zeros(0, np.int64), np.zeros(0, U64))

    def code_of(feat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.minimum(np.searchsorted(keys, feat), max(len(keys) - 1, 0))
        return place, (keys[place] == feat if len(keys) else np.zeros(len(feat), bool))

    place, ok = code_of(feat)
    own = [set(place[ok & (word == t)].tolist()) for t in range(len(ts))]
    found: dict[tuple, float] = {}
    for _, data, s, e, sent in parts:
        hashes = span_hashes(data, s, e) if len(s) else np.zeros(0, U64)
        held = np.unique(sent[np.isin(hashes, names)])
        at = np.flatnonzero(np.isin(sent, held))  # words of sentences with terms
        if not len(at):
            continue
        w, f = features(data, s[at], e[at])
        code, ok = code_of(f)
        cell, count = np.unique(sent[at[w[ok]]] * len(keys) + code[ok], return_counts=True)  # words of a sentence with a feature
        first = 0
        for g in groups:
            terms = range(first, first + len(g))
            first += len(g)
            codes = np.array(sorted(set().union(*(own[t] for t in terms))), np.int64)
            for t in terms:
                mine, m = np.unique(sent[at[hashes[at] == names[t]]], return_counts=True)
                if not len(mine) or len(g) < 2:
                    continue
                want = mine[:, None] * len(keys) + codes
                where = np.minimum(np.searchsorted(cell, want), len(cell) - 1)
                n = np.where(cell[where] == want, count[where], 0)
                status = np.where(n == 0, 0, np.where(n == m[:, None], 1, 2))  # no word has it, the term alone, others too
                for row, times in zip(*np.unique(status, axis=0, return_counts=True), strict=True):
                    has = dict(zip(codes.tolist(), row.tolist(), strict=True))
                    for other in terms:
                        if other != t:
                            lost = [c for c in own[t] if has[c] == 1 and c not in own[other]]
                            new = [c for c in own[other] if has[c] == 0]
                            key = (tuple(sorted(lost)), tuple(sorted(new)))
                            found[key] = found.get(key, 0.0) + times / (len(g) - 1)
    rows = [(r, c, sign) for r, (lost, new) in enumerate(sorted(found)) for cs, sign in ((lost, -1.0), (new, 1.0)) for c in cs]
    r, c, sign = zip(*rows, strict=True) if rows else ([], [], [])
    return Swaps(np.array(r, np.int64), np.array(c, np.int64), np.array(sign, float), np.array([found[k] for k in sorted(found)], float))


def fit(texts: pa.Array, label: np.ndarray, doc: np.ndarray, groups: tuple[tuple[str, ...], ...] = IDENTITY_GROUPS, ridge: float = RIDGE, penalty: float = SWAP_PENALTY, rounds: int = ROUNDS, min_z: float = MIN_Z) -> Model:
    """Model of sentences: a text, a label from 0 to 1 and a document number each."""
    if not len(label) or label.max() <= 0 or label.min() >= 1:
        return Model()
    base = float(label.mean())
    _, doc = np.unique(doc, return_inverse=True)
    parts = []
    for lo, hi in slices(texts, 1 << 20):
        data, starts, ends = column_bytes(pc.utf8_lower(texts.slice(lo, hi - lo)))
        s, e, first = word_spans(data, starts, ends)
        parts.append((lo, data, s, e, np.repeat(np.arange(lo, hi), np.diff(first))))

    def pairs(part: tuple) -> tuple[np.ndarray, np.ndarray]:
        """(sentence, feature) of one part, each once."""
        _, data, s, e, sent = part
        word, feat = features(data, s, e)
        uniq, code = np.unique(feat, return_inverse=True)
        p = np.unique(sent[word] * len(uniq) + code)
        return p // len(uniq), uniq[p % len(uniq)]

    # statistics of each feature: how far labels stray, and the squares of its count in each document
    stats = []
    for part in parts:
        if not len(part[2]):
            continue
        sent, feat = pairs(part)
        uniq, code = np.unique(feat, return_inverse=True)
        cell, n = np.unique(code * (int(doc.max()) + 1) + doc[sent], return_counts=True)
        stats.append((uniq, np.bincount(code, weights=label[sent] - base), np.bincount(cell // (int(doc.max()) + 1), weights=n.astype(float) ** 2)))
    if not stats:
        return Model()
    keys, code = np.unique(np.concatenate([x[0] for x in stats]), return_inverse=True)
    stray, chance = (np.bincount(code, weights=np.concatenate([x[k] for x in stats])) for k in (1, 2))
    term_data, ts, te = column_bytes(pc.utf8_lower(pa.array([x for g in groups for x in g], pa.string())))
    whole = span_hashes(term_data, ts, te) if len(ts) else np.zeros(0, U64)
    keys = keys[np.abs(stray) >= min_z * np.sqrt(chance * base * (1 - base))]
    bare = [whole]  # a beginning brings the word that is nothing more, which may well be harmless
    for _, data, s, e, _ in parts:
        if len(s):
            short = np.flatnonzero(e - s <= PREFIXES[-1])
            word, feat = features(data, s[short], e[short])
            size = np.concatenate([np.zeros(len(short), np.int64), *[np.full((e[short] - s[short] >= k).sum(), k) for k in PREFIXES]])
            own = word[(size == (e - s)[short][word]) & np.isin(feat, keys)]
            bare.append(np.unique(span_hashes(data, s[short][own], e[short][own])) if len(own) else whole)
    keys = np.union1d(keys, np.concatenate(bare))

    def code_of(feat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.minimum(np.searchsorted(keys, feat), max(len(keys) - 1, 0))
        return place, (keys[place] == feat if len(keys) else np.zeros(len(feat), bool))

    sents, xs, begins = [], [], [_beginnings(term_data, ts, te)]
    for part in parts:
        if len(part[2]):
            sent, feat = pairs(part)
            place, ok = code_of(feat)
            sents.append(sent[ok])
            xs.append(place[ok])
            word, feat = features(part[1], part[2], part[3])
            hit = np.unique(word[code_of(feat)[1]])
            begins.append(np.unique(_beginnings(part[1], part[2][hit], part[3][hit])))
    sent, x = np.concatenate(sents), np.concatenate(xs)
    swaps = _swaps(parts, groups, keys)
    w, bias = np.zeros(len(keys)), float(np.log(base / (1 - base)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(sent, weights=w[x], minlength=len(label)) + bias
        r = 1 / (1 + np.exp(np.clip(-z, -500, 500))) - label
        g = np.bincount(x, weights=r[sent], minlength=len(w)) + ridge * w
        if len(swaps.times):
            change = np.bincount(swaps.row, weights=swaps.sign * w[swaps.feature], minlength=len(swaps.times))
            g += penalty * np.bincount(swaps.feature, weights=swaps.sign * (swaps.times * change)[swaps.row], minlength=len(w))
        gb = float(r.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.2 * (1 - 0.8 * t / rounds)
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-9)
    return Model(keys, w, np.unique(np.concatenate(begins)), bias)


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi in slices(b.column("text")):
            data, s, e, sent, row = sentences(b.column("text").slice(lo, hi - lo))
            if not len(row):
                continue
            first = np.searchsorted(sent, np.arange(len(row)))
            last = np.append(first[1:], len(s)) - 1
            raw = data.tobytes()
            text = pa.array([raw[i:j].decode() for i, j in zip(s[first].tolist(), e[last].tolist(), strict=True)], pa.string())
            pick = pa.array(row + lo)
            yield pa.RecordBatch.from_arrays([text, b.column("toxic").take(pick).cast(pa.float64()), b.column("doc_id").take(pick)], ["text", "toxic", "doc"])


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, **kw) -> Model:
    """Model fitted on a hash sample of at most about ``max_labelled`` labelled documents."""
    y = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")).checkpoint()
    total = y.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_003)) < int(1_000_003 * min(1.0, max_labelled / max(total, 1)) + 1)
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    sample = d.where(draw).join(y.where(draw), "doc_id").select("doc_id", "text", "toxic").checkpoint()
    rows = sample.mapInArrow(_labelled, "text string, toxic double, doc bigint")
    rows = rows.groupBy("text").agg(F.avg("toxic").alias("toxic"), F.min("doc").alias("doc")).checkpoint()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    share = F.pmod(F.xxhash64("text", F.lit(23)), F.lit(1_000_003)) < int(1_000_003 * min(1.0, MAX_SENTENCE_BYTES / max(size, 1)) + 1)
    got = rows.where(share).toArrow().combine_chunks().sort_by("text")  # the same model however rows arrive
    text = got["text"].combine_chunks() if got.num_rows else pa.array([], pa.string())
    model = fit(text, got["toxic"].to_numpy(), got["doc"].to_numpy(), **kw)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.concatenate([shipped.value.evidence(b.column("text").slice(lo, hi - lo)) for lo, hi in slices(b.column("text"))] or [np.zeros((0, 3))])
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, k]) for k in range(3)), b.column("toxic").cast(pa.float64())], ["first", "second", "n", "toxic"])

    x = sample.mapInArrow(seen, "first double, second double, n double, toxic double").toArrow().combine_chunks()
    x = np.stack([x[c].to_numpy() for c in x.column_names], 1)
    x = x[np.lexsort(x.T)]
    return calibrate(model, x[:, :3], x[:, 3])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, toxic) of every row of ``docs``."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column("text")):
                p = shipped.value.score(b.column("text").slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(p), pa.array(p >= threshold)], ["doc_id", "score", "toxic"])

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(releasing(go), "doc_id bigint, score double, toxic boolean")


def toxic_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose text is toxic; the columns stay as they are."""
    shipped = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column("text")
            keep = [shipped.value.score(text.slice(lo, hi - lo)) < threshold for lo, hi in slices(text)]
            yield b.filter(pa.array(np.concatenate(keep))) if keep else b

    return docs.mapInArrow(releasing(go), docs.schema)
