"""Toxicity: held-out accuracy, counterfactual invariance, defined cases."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import toxicity as tox
from lectern.llm._vec import column_bytes, word_spans

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, toxic string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def data():
    """Insults are toxic; identity terms stand in toxic texts more often than in clean ones."""
    rng = random.Random(2)
    words, bad = [f"plain{i}" for i in range(80)], ["vilex", "scumz", "dreckfoo"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        sents = []
        for _ in range(rng.randint(2, 12)):
            s = [rng.choice(words) for _ in range(rng.randint(4, 10))]
            if toxic and (rng.random() < 0.4 or not sents):
                s.insert(rng.randrange(len(s)), rng.choice(bad) + rng.choice(["", "er", "ing"]))
            if rng.random() < (0.5 if toxic else 0.05):
                s.insert(rng.randrange(len(s)), rng.choice(["muslim", "jewish", "women"]))
            sents.append(" ".join(s))
        rows.append((i, ". ".join(sents) + "."))
        labels.append((i, 1, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def model(spark, data):
    rows, labels = data
    return tox.train(frame(spark, rows), spark.createDataFrame([x for x in labels if x[0] < 400], "doc_id bigint, quality int, toxic int"))


def test_held_out_accuracy(spark, data, model):
    rows, labels = data
    p = model.score(pa.array([t for i, t in rows if i >= 400]))
    y = np.array([t for i, _, t in labels if i >= 400])
    assert ((p >= tox.THRESHOLD) == (y == 1)).mean() >= 0.97


def test_swapped_identity_terms_hardly_change_the_score(data, model):
    base = "plain1 plain2 {} plain3 plain4"
    p = model.score(pa.array([base.format(x) for x in ("muslim", "christian", "jewish", "atheist")]))
    assert np.ptp(p) < 0.05 and p.max() < tox.THRESHOLD
    rows, labels = data
    texts, y, d = pa.array([t for _, t in rows]), np.array([float(t) for _, _, t in labels]), np.array([i for i, _ in rows])
    free, held = (tox.fit(texts, y, d, penalty=k) for k in (0.0, tox.SWAP_PENALTY))
    pair = pa.array([base.format("muslim"), base.format("hindu")])
    assert np.ptp(held.evidence(pair)[:, 0]) < 0.3 * np.ptp(free.evidence(pair)[:, 0])


def dense_fit(texts, label, groups, keys, rounds):
    """The same model by dense matrices over sets of features; every swapped sentence is written out."""
    def bag(words):
        data, s, e = column_bytes(pa.array([" ".join(words)]))
        ws, we, _ = word_spans(data, s, e)
        return set(tox.features(data, ws, we)[1].tolist()) if len(ws) else set()

    place = {int(k): i for i, k in enumerate(keys)}

    def row(words):
        out = np.zeros(len(keys))
        out[[place[f] for f in bag(words) if f in place]] = 1
        return out

    sents = [t.split() for t in texts]
    x = np.stack([row(w) for w in sents])
    swapped, weight = [], []
    for k, words in enumerate(sents):
        for g in groups:
            for t in set(words) & set(g):
                for other in set(g) - {t}:
                    swapped.append(row([other if w == t else w for w in words]) - x[k])
                    weight.append(1 / (len(g) - 1))
    d, c = np.stack(swapped), np.array(weight)
    base = label.mean()
    w, bias = np.zeros(len(keys)), np.log(base / (1 - base))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        r = 1 / (1 + np.exp(-(x @ w + bias))) - label
        g, gb = x.T @ r + tox.RIDGE * w + tox.SWAP_PENALTY * d.T @ (c * (d @ w)), r.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.2 * (1 - 0.8 * t / rounds)
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-9)
    return w, bias


def test_against_a_dense_fit_with_every_sentence_swapped():
    """Sentences that hold two terms of a group, a term twice, or words that begin like one."""
    rng = random.Random(6)
    groups = (("muslim", "christian", "jewish"), ("women", "men"), ("frauen", "männer"))
    words = [f"w{i}" for i in range(12)] + ["vilex", "muslims", "womens", "menace", "jewishness"]
    texts, label = [], []
    for i in range(150):
        own = [rng.choice(words) for _ in range(rng.randint(2, 6))] + rng.choices([x for g in groups for x in g], k=rng.randint(0, 3))
        rng.shuffle(own)
        texts.append(" ".join(own))
        label.append(float("vilex" in own or rng.random() < 0.1 + 0.3 * ("muslim" in own)))
    label = np.array(label)
    model = tox.fit(pa.array(texts), label, np.arange(150), groups=groups, rounds=40, min_z=0.5)
    w, bias = dense_fit(texts, label, groups, model.keys, 40)
    assert len(model.keys) > 30 and np.allclose(model.weights, w, atol=1e-6) and abs(model.bias - bias) < 1e-6


@pytest.mark.parametrize("terms", [("muslim", "christian"), ("muslimische", "jüdische"), ("musulmans", "juifs"), ("judíos", "ateos")])
def test_fewer_false_positives_on_neutral_mentions(terms):
    """A group that is named in toxic sentences mostly: neutral mentions are rejected without the penalty, and no more with it."""
    rng = random.Random(3)
    words = [f"plain{i}" for i in range(60)]
    texts, label = [], []
    for i in range(900):
        toxic, own = i % 3 == 0, [rng.choice(words) for _ in range(6)]
        if toxic:
            own.append(rng.choice(["vilex", "scumz"]) if rng.random() < 0.6 else rng.choice(words))
        if rng.random() < (0.8 if toxic else 0.02):
            own.append(terms[0])
        rng.shuffle(own)
        texts.append(" ".join(own))
        label.append(float(toxic))
    neutral = pa.array([" ".join([rng.choice(words) for _ in range(6)] + [terms[0]]) for _ in range(200)])
    bad = pa.array([" ".join([rng.choice(words) for _ in range(5)] + ["vilex"]) for _ in range(200)])
    free, held = (tox.fit(pa.array(texts), np.array(label), np.arange(900), penalty=p) for p in (0.0, tox.SWAP_PENALTY))
    rate = lambda model, x: (model.evidence(x)[:, 0] > 0).mean()
    assert rate(free, neutral) > 0.8 and rate(held, neutral) < 0.05 and rate(held, bad) > 0.95


def test_held_out_documents_of_the_corpus(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = tox.train(docs, labels.where("pmod(xxhash64(doc_id), 3) <> 0"))
    test = tox.score(docs, model).withColumnRenamed("toxic", "said").join(labels.where("pmod(xxhash64(doc_id), 3) = 0"), "doc_id").toPandas()
    assert (test.said == (test.toxic == 1)).mean() >= 0.9


def test_the_same_model_whatever_the_layout(spark, data, model):
    rows, labels = data
    again = tox.train(frame(spark, rows).repartition(5), spark.createDataFrame([x for x in labels if x[0] < 400], "doc_id bigint, quality int, toxic int").repartition(3))
    assert np.array_equal(again.weights, model.weights) and np.allclose(again.whole, model.whole)


def test_defined_cases(spark, data):
    rows, labels = data
    extra = [(1000, None), (1001, ""), (1002, "..."), (None, "vilex scumz. vilex"), (1003, "plain1 " * 200_000), (1004, "vilex scumz"), (1004, "vilex scumz")]
    docs = frame(spark, rows + extra)
    y = spark.createDataFrame([*labels, (None, 1, 1), (1003, 1, None), (4, 0, 0), (4, 0, 0)], "doc_id bigint, quality int, toxic int")
    got = {}
    for r in tox.toxic_documents(docs, y).where("doc_id >= 1000 or doc_id is null").collect():
        got.setdefault(r.doc_id, []).append((round(r.score, 3), r.toxic))
    assert got[1000] == got[1001] == got[1002] == [(0.0, False)] and not got[1003][0][1]
    assert got[None][0][1] and got[1004][0] == got[1004][1]
    kept = tox.reject_toxic(docs, y)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.where("doc_id >= 1000 or doc_id is null").collect()}
    assert {1000, 1001, 1002, 1003} <= ids and None not in ids
    assert tox.reject_toxic(docs.limit(0), y).count() == 0
    for none in (y.limit(0), y.where("toxic = 0")):
        assert {(r.score, r.toxic) for r in tox.toxic_documents(docs, none).collect()} == {(0.0, False)}
        assert tox.reject_toxic(docs, none).count() == docs.count()
