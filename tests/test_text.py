"""Measures, lines, numerals and budgets on small cases."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import budgets, numerals
from lectern.functions import text as tx
from lectern.operators.lines import lines, running_total, source_spans
from lectern.operators.sanitize import MARKER, RULE, sanitize


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("r")).first().r


@pytest.mark.parametrize(("text", "dense", "tokens", "words"), [
    ("", 0, 0, 0), ("four char word here", 0, 4, 4), ("汉字" * 3, 6, 4, 6), ("汉字 and words", 2, 3, 4), ("สวัสดี", 6, 4, 6), ("\U00020000x", 1, 0, 2), (None, None, None, None), ("a b　c", 1, 1, 4),
])
def test_measures(spark, text, dense, tokens, words):
    got = tuple(one(spark, text, f) for f in (tx.count_dense, tx.estimate_tokens, tx.count_words))
    assert got == (dense, tokens, words)


@pytest.mark.parametrize(("chars", "pages"), [(0, 1), (900, 1), (2700, 2), (4500, 2), (5400, 3)])
def test_pages_round_half_to_even(spark, chars, pages):
    assert one(spark, "x" * chars, lambda t: tx.page_estimate(F.length(t))) == pages


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\n\n", "\n", "a\r\nb\rc", "a\x0bb\x0cc\x1cd\u0085e f g", "a\n\n\nb"])
def test_lines_as_python_has_them(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    got = [(r.line_no, r.line) for r in lines(df, ["doc_id"]).orderBy("line_no").collect()]
    assert got == list(enumerate(text.splitlines(), 1))


def test_frontmatter_once(spark):
    assert one(spark, "---\na: 1\n---\nbody\n---\nb\n---\n", tx.strip_frontmatter) == "body\n---\nb\n---\n"
    assert one(spark, "x\n---\na\n---\n", tx.strip_frontmatter) == "x\n---\na\n---\n"


def test_excerpt_and_host(spark):
    assert one(spark, "  " + "x" * 200, tx.excerpt) == "x" * 119 + "…"
    assert one(spark, "https://A.example.org:80/x", tx.link_host) == "a.example.org"


def test_natural_order(spark):
    names = ["ch10", "ch2", "B", "a", "ch1", "ch20", "2a", "10a"]
    got = [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(tx.natural_key(F.col("n"))).collect()]
    assert got == ["2a", "10a", "a", "B", "ch1", "ch2", "ch10", "ch20"]


@pytest.mark.parametrize(("parse", "token", "value"), [
    ("roman", "XIV", 14), ("roman", "MCM", 1900), ("roman", "ild", 449), ("roman", "", None), ("roman", "XA", None), ("han", "十二", 12), ("han", "一百零八", 108), ("han", "二十三", 23), ("han", "一二", 2),
    ("han", "１２", 12), ("han", "零", None), ("han", "x", None), ("thai", "๑๒", 12), ("arabic", "１２", 12), ("arabic", "x", None), ("arabic", "99999999999", None),
])
def test_numerals(spark, parse, token, value):
    assert one(spark, token, getattr(numerals, f"parse_{parse}")) == value


def test_budgets(spark):
    cells = [(d, k) for d in ("study", "reference") for k in ("text", "technical")]
    df = spark.createDataFrame([(n, d, k) for n in range(0, 51) for d, k in cells], "n int, d string, k string")
    rows = df.select("n", "d", "k", budgets.reference_budget(F.col("n"), F.col("d"), F.col("k")).alias("b"), budgets.reference_cap(F.col("d"), F.col("k")).alias("c")).collect()
    assert {(r.d, r.k): r.c for r in rows} == {("study", "text"): 14000, ("reference", "text"): 8500, ("study", "technical"): 19500, ("reference", "technical"): 11000}
    assert all((r.b is None) == (r.n < 1) and (r.b is None or r.b <= r.c) for r in rows)
    for n, actual in ((11, 8156), (19, 10323), (21, 9358), (22, 11149), (25, 10557)):
        assert abs(next(r.b for r in rows if (r.n, r.d, r.k) == (n, "study", "text")) - actual) / actual < 0.1


def test_sanitize(spark):
    forged = f"first\n{RULE}\n{MARKER}other.pdf (Path: x)\n{RULE}\nlast"
    out = one(spark, forged, sanitize)
    assert RULE not in out and f"\n[quoted] {MARKER}other.pdf" in out and "-" * 80 in out
    assert one(spark, "éa​\x07b\r\nc  \t\r\rd    e\n\n\n\n\n\nf ", sanitize) == "éab\nc\n\nd  e\n\n\nf\n"
    assert one(spark, "", sanitize) == "" and one(spark, None, sanitize) is None and one(spark, " \n ", sanitize) == "\n"
    assert one(spark, "x " * 300_000, sanitize).count("x") == 300_000


def test_spans_are_disjoint_and_isolate_their_source(spark):
    docs = [(i, "\n".join(f"{i}.{k}" for k in range(i % 5))) for i in range(40)] + [(40, None), (41, "end\n")]
    df = spark.createDataFrame(docs, "doc_id int, text string").repartition(7)
    corpus = []
    for _, text in docs:
        corpus += ["f"] * 3 + ((text or "") + ("" if (text or "").endswith("\n") else "\n")).split("\n")[:-1]
    for r in source_spans(df, ["doc_id"]).collect():
        text = docs[r.doc_id][1] or ""
        assert "\n".join(corpus[r.start_line - 1 : r.end_line]) == text.rstrip("\n")


def test_running_total_of_nothing(spark):
    assert running_total(spark.createDataFrame([], "k int, n bigint"), ["k"], "n", "t").count() == 0
