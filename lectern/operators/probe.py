"""Boundary probing: several strategies propose section boundaries, each is scored, the best is named.

Each strategy is a column expression from the array of a document's lines to an array of candidates
(line, label, number), so a document is probed inside its row and nothing is shuffled. A strategy
without candidates keeps its row, with score 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import BLANK, let, split_lines, strip, strip_chars
from lectern.operators.structure import headings_of

LEAST, MOST, MAX_LEVEL, LOOKBACK, LABEL = 3, 120, 2, 20, 90
Names = tuple[str, ...]
CANDIDATES = "array<struct<line:int,label:string,number:double>>"
_S, _N = f"[{BLANK}]", f"[^{BLANK}]"
MARKDOWN = rf"\A(#{{1,6}}){_S}+(.+?){_S}*\z"
NUMBERED = rf"\A{_S}*([0-9]{{1,2}}(?:\.[0-9]{{1,2}}){{1,3}}){_S}+([A-Z].{{3,90}}?){_S}*\z"
DOI = rf"10\.[0-9]{{4,9}}/[\w().:;/-]*?(?:{_S}|_)+([0-9]{{1,3}})(?U:\b)"
ABSTRACT = rf"\A{_S}*\**Abstract\**{_S}+{_N}|\A{_S}*#*{_S}*\**Abstract\**{_S}*\z"
ALLCAPS = rf"\A{_S}*([A-Z][0-9A-Z ():,&'-]{{7,70}}){_S}*\z"
CHROME = r"\A(?:Link:|http|!\[|<!--|\|)"


def _candidate(line: Column, label: Column, number: Column | None = None) -> Column:
    return F.struct(line.cast("int").alias("line"), F.left(label, F.lit(LABEL)).alias("label"), (F.lit(None) if number is None else number).cast("double").alias("number"))


def _matching(lines: Column, pattern: str, make: Callable[[Column, Column], Column]) -> Column:
    numbered = F.transform(lines, lambda x, i: F.struct((i + 1).alias("line"), x.alias("text")))
    return F.transform(F.filter(numbered, lambda x: x["text"].rlike(pattern)), lambda x: make(x["line"], x["text"]))


def canonical(lines: Column) -> Column:
    return F.transform(headings_of(lines), lambda h: _candidate(h["line"], F.concat(h["number"].cast("string"), F.lit(" "), h["title"]), h["number"]))


def markdown(lines: Column, max_level: int = MAX_LEVEL) -> Column:
    return _matching(lines, MARKDOWN.replace("{1,6}", f"{{1,{max_level}}}"), lambda n, x: _candidate(n, F.regexp_extract(x, MARKDOWN, 2)))


def numbered(lines: Column) -> Column:
    found = F.filter(lines_with(lines, NUMBERED), lambda x: F.regexp_extract(x["text"], NUMBERED, 1).rlike(r"\A[0-9]+\.[0-9]+\z"))
    number = lambda x: F.regexp_extract(x["text"], NUMBERED, 1)
    return F.transform(found, lambda x: _candidate(x["line"], F.concat(number(x), F.lit(" "), F.regexp_extract(x["text"], NUMBERED, 2)), number(x).try_cast("double")))


def lines_with(lines: Column, pattern: str) -> Column:
    return _matching(lines, pattern, lambda n, x: F.struct(n.alias("line"), x.alias("text")))


def doi(lines: Column) -> Column:
    hits = _matching(lines, DOI, lambda n, x: F.struct(F.regexp_extract(x, DOI, 1).cast("int").alias("number"), n.alias("line")))
    hits = F.array_sort(F.filter(hits, lambda h: h["number"].between(1, 99)))
    first = let(hits, lambda s: F.filter(s, lambda h, i: (i == 0) | (h["number"] != s[i - 1]["number"])))
    return F.array_sort(F.transform(first, lambda h: _candidate(h["line"], F.concat(F.lit("chapter "), h["number"].cast("string"), F.lit(" (DOI marker)")), h["number"])))


def title_above(lines: Column, line: Column) -> Column:
    """Nearest markdown heading within ``LOOKBACK`` lines above ``line``, else the nearest line that reads like a title; the first line of a document is never looked at."""
    start = F.greatest(line - LOOKBACK, F.lit(2))
    above = F.reverse(F.transform(F.slice(lines, start, F.greatest(line - start, F.lit(0))), strip))

    def choose(rows: Column) -> Column:
        heads = F.filter(F.transform(F.filter(rows, lambda x: x.startswith("#")), lambda x: strip(strip_chars(x, "#", right=False))), lambda x: F.length(x) > 3)
        others = F.filter(rows, lambda x: (F.length(x) > 3) & ~x.rlike(CHROME) & ~F.replace(x, F.lit("."), F.lit("")).rlike(r"(?U)\A\d+\z"))
        return F.coalesce(F.get(heads, F.lit(0)), F.get(others, F.lit(0)))

    return let(above, choose)


def abstract(lines: Column) -> Column:
    return let(lines, lambda own: _matching(own, ABSTRACT, lambda n, _: _candidate(n, F.coalesce(title_above(own, n), F.lit("(untitled abstract)")))))


def allcaps(lines: Column) -> Column:
    return _matching(lines, ALLCAPS, lambda n, x: _candidate(n, F.regexp_extract(x, ALLCAPS, 1)))


STRATEGIES: dict[str, Callable[[Column], Column]] = {"canonical": canonical, "markdown": markdown, "numbered": numbered, "doi": doi, "abstract": abstract, "allcaps": allcaps}


def score(candidates: Column, total_lines: Column) -> Column:
    """0 to 1, three decimals: spread, evenness and rising numbers, less a penalty for very many candidates."""
    one = F.lit(1.0)

    def parts(c: Column) -> Column:
        n = F.size(c)
        at = F.transform(c, lambda x: x["line"].cast("double"))
        span = F.element_at(at, -1) - F.element_at(at, 1)
        mean = span / (n - 1)
        squares = let(at, lambda a: F.aggregate(F.transform(F.slice(a, F.lit(2), F.size(a) - 1), lambda x, i: F.pow(x - a[i] - mean, F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))
        even = F.when((mean > 0) & (n > 2), F.greatest(F.lit(0.0), one - F.sqrt(squares / (n - 1)) / mean / 2)).otherwise(0.5)
        numbers = F.filter(F.transform(c, lambda x: x["number"]), lambda x: x.isNotNull())
        rising = let(numbers, lambda a: F.when(F.size(a) >= 2, F.size(F.filter(F.transform(F.slice(a, F.lit(2), F.size(a)), lambda x, i: x > a[i]), lambda up: up)) / (F.size(a) - 1)).otherwise(0.6))
        spread = F.least(one, span / total_lines / 0.7)
        penalty = F.when(n <= MOST, F.lit(0.0)).otherwise(F.least(one, (n - MOST) / F.lit(float(MOST))))
        value = (F.lit(0.35) * spread + F.lit(0.35) * even + F.lit(0.3) * rising) * (one - penalty)
        return F.when((n < LEAST) | (total_lines <= 0), F.lit(0.0)).otherwise(F.round(F.greatest(F.lit(0.0), value), 3))

    return let(candidates, parts)


def probe(df: DataFrame, id_column: str = "doc_id", text: str = "text", strategies: Names | None = None, max_level: int = MAX_LEVEL) -> DataFrame:
    """(id, total_lines, strategy, candidates, n, score): a row for each document and strategy; unknown names are passed over."""
    chosen = {k: f for k, f in STRATEGIES.items() if strategies is None or k in strategies}
    if "markdown" in chosen:
        chosen["markdown"] = lambda lines: markdown(lines, max_level)

    def results(lines: Column) -> Column:
        rows = [F.struct(F.lit(k).alias("strategy"), f(lines).cast(CANDIDATES).alias("candidates"), F.size(lines).alias("total_lines")) for k, f in chosen.items()]
        return F.array(*rows)

    found = df.select(id_column, F.explode(let(split_lines(F.coalesce(F.col(text), F.lit(""))), results)).alias("r"))
    return found.select(id_column, "r.total_lines", "r.strategy", "r.candidates", F.size("r.candidates").alias("n"), score(F.col("r.candidates"), F.col("r.total_lines")).alias("score"))


def candidate_rows(probed: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, strategy, line, label, number): a row for each candidate."""
    return probed.select(id_column, "strategy", F.explode("candidates").alias("c")).select(id_column, "strategy", "c.line", "c.label", "c.number")


def best(probed: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, strategy, n, score): the best-scored strategy with at least ``LEAST`` candidates; ties go by name."""
    fit = probed.where(F.col("n") >= LEAST)
    top = fit.groupBy(id_column).agg(F.min(F.struct((-F.col("score")).alias("s"), "strategy", "n", "score")).alias("b"))
    return top.select(id_column, "b.strategy", "b.n", "b.score")


def ranked(probed: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, strategy, n, score, place): all strategies, the best-scored first; ties go by name."""
    order = Window.partitionBy(id_column).orderBy(F.col("score").desc(), "strategy")
    return probed.select(id_column, "strategy", "n", "score", F.row_number().over(order).alias("place"))


def shown(probed: DataFrame, first: int, id_column: str = "doc_id") -> DataFrame:
    """``probed`` with the first candidates of each strategy only, for a report; 0 shows all."""
    return probed.withColumn("candidates", F.slice("candidates", 1, first)) if first > 0 else probed
