"""Line filters that strip boilerplate from text on its way to being read.

A filter is a column expression from an array of lines to an array of lines, and a document is
cleaned inside its row: no filter shuffles, whatever windows over lines it would take. They run in
a fixed order, each over what its predecessors kept: pdf, rst, nav, quiz, repeats, blanks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import BLANK, estimate_tokens, let, split_lines, strip, strip_chars

_S = f"[{BLANK}]"
PIPE_ROW = rf"\A{_S}*\|.*\|{_S}*\z"
PAGE_MARKER = rf"(?i)\A{_S}*<!--{_S}*page{_S}+[0-9]+{_S}*-->{_S}*\z"
PAGE_MARKER_TEXT = rf"(?idm)^{_S}*<!--{_S}*page{_S}+[0-9]+{_S}*-->{_S}*$"
PDF_LINE = rf"\A{_S}*(?:Link:{_S}*\[|!\[)|\A{_S}*!?\[?[^\]]*\]?\(asset:sha256:[a-f0-9]+\){_S}*\z"
RST_OPTIONS = "alt align caption class figclass height hidden linenos maxdepth name scale target titlesonly width".split()
RST_LINE = rf"\A{_S}*(?:\.\.{_S}+[A-Za-z_][\w-]*::|:(?:{'|'.join(RST_OPTIONS)}):)|\A{_S}*(?:[`'*+#^~\"=-]{{3,}}|\.\.{_S}+_?[\w.-]+:?){_S}*\z"
NAV = tuple("back to top|contact us|further reading|home|index|next|previous|skip to main content|skip to navigation|table of contents|×|-".split("|"))
Names = tuple[str, ...]
QUIZ = ("self-test", "review questions", "check your understanding", "test your knowledge")
MANGLED, REPEATS, REPEAT_LENGTH = 0.6, 4, 12


def mangled_row(line: Column) -> Column:
    """A table row of which at least ``MANGLED`` of the cells are empty or only rule signs."""
    cells = F.split(strip_chars(strip(line), "|"), r"\|")
    share = let(cells, lambda c: F.size(F.filter(c, lambda x: x.rlike(rf"\A[{BLANK}:-]*\z"))) / F.size(c))
    return F.when(line.rlike(PIPE_ROW), share >= MANGLED).otherwise(F.lit(False))


def pdf(lines: Column) -> Column:
    return F.filter(lines, lambda x: ~(x.rlike(PAGE_MARKER) | x.rlike(PDF_LINE) | mangled_row(x)))


def rst(lines: Column) -> Column:
    return F.filter(lines, lambda x: ~x.rlike(RST_LINE))


def nav(lines: Column) -> Column:
    return F.filter(lines, lambda x: ~F.lower(strip(strip_chars(strip(x), "-*# ", right=False))).isin(*NAV))


def quiz(lines: Column) -> Column:
    """Up to the first quiz marker; what follows it is end matter."""

    def cut(own: Column) -> Column:
        marker = F.array_position(F.transform(own, lambda x: strip_chars(strip_chars(F.lower(strip(x)), "#* ", right=False), "* ", left=False).isin(*QUIZ)), F.lit(True))
        return let(marker, lambda at: F.when(at > 0, F.slice(own, F.lit(1), (at - 1).cast("int"))).otherwise(own))

    return let(lines, cut)


def repeats(lines: Column, threshold: int = REPEATS, min_len: int = REPEAT_LENGTH) -> Column:
    """Without lines that occur ``threshold`` times or more; short lines and table rows stay."""

    def drop(own: Column) -> Column:
        counted = F.array_sort(F.transform(F.filter(own, lambda x: (F.length(strip(x)) >= min_len) & ~x.rlike(PIPE_ROW)), strip))
        noisy = let(counted, lambda s: F.array_distinct(F.filter(s, lambda x, i: (i + threshold <= F.size(s)) & (x == F.get(s, i + (threshold - 1))))))
        return let(noisy, lambda n: F.when(F.size(n) == 0, own).otherwise(F.filter(own, lambda x: x.rlike(PIPE_ROW) | ~F.array_contains(n, strip(x)))))

    return let(lines, drop)


def blanks(lines: Column) -> Column:
    """Runs of blank lines become one empty line."""

    def squeeze(own: Column) -> Column:
        kept = F.filter(own, lambda x, i: (strip(x) != "") | (i == 0) | (strip(F.get(own, i - 1)) != ""))
        return F.transform(kept, lambda x: F.when(strip(x) == "", "").otherwise(x))

    return let(lines, squeeze)


FILTERS: dict[str, Callable[[Column], Column]] = {"pdf": pdf, "rst": rst, "nav": nav, "quiz": quiz, "repeats": repeats, "blanks": blanks}


def _where(wanted: Column, f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda lines: F.when(wanted, f(lines)).otherwise(lines)


def detect_filters(text: Column) -> Column:
    """Names of the filters that the text calls for, in order."""
    low = F.lower(text)

    def any_of(value: Column, words: tuple[str, ...]) -> Column:
        return F.array_max(F.array(*[F.contains(value, F.lit(w)) for w in words]))

    wanted = {
        "pdf": text.rlike(PAGE_MARKER_TEXT) | F.contains(text, F.lit("Link: [")),
        "rst": any_of(text, (".. figure::", ".. note::", ".. toctree::")),
        "nav": any_of(low, ("table of contents", "skip to main content")),
        "quiz": any_of(low, QUIZ),
    }
    return F.array_compact(F.array(*[F.when(wanted[k], F.lit(k)) if k in wanted else F.lit(k) for k in FILTERS]))


def clean(df: DataFrame, text: str = "text", filters: Names | None = None) -> DataFrame:
    """``df`` with its text cleaned, lines_before, lines_after, percent_removed, tokens_before, tokens_after, tokens_saved, percent_saved and applied.

    Without ``filters`` each document's own are detected; unknown names are passed over. A null text is an empty one.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    applied = detect_filters(value) if filters is None else F.array(*[F.lit(k) for k in FILTERS if k in filters]).cast("array<string>")

    def run(own: Column) -> Column:
        out = own
        for name, f in FILTERS.items():
            if filters is None:
                out = let(out, _where(F.array_contains(applied, name), f))
            elif name in filters:
                out = f(out)
        return F.struct(F.size(own).alias("before"), out.alias("kept"))

    out = df.withColumn("applied", applied).withColumn("__cleaned", let(split_lines(value), run))
    before, after = F.col("__cleaned.before"), F.size("__cleaned.kept")
    joined = F.concat(strip(F.array_join("__cleaned.kept", "\n")), F.lit("\n"))
    share = F.when(before == 0, F.lit(0.0)).otherwise(F.round(F.lit(100.0) * (before - after) / before, 1))
    out = out.withColumns({"lines_before": before, "lines_after": after, "percent_removed": share, "tokens_before": estimate_tokens(value), "tokens_after": estimate_tokens(joined)})
    saved = F.col("tokens_before") - F.col("tokens_after")
    out = out.withColumns({"tokens_saved": saved, "percent_saved": F.when(F.col("tokens_before") == 0, F.lit(0.0)).otherwise(F.round(F.lit(100.0) * saved / F.col("tokens_before"), 1))})
    return out.withColumn(text, joined).drop("__cleaned")


def write_cleaned(cleaned: DataFrame, keys: list[str], path: str, text: str = "text") -> None:
    """``cleaned`` as two tables under ``path``: ``text``, and ``report`` as JSON, a row for each document."""
    cleaned.select(*keys, text).write.mode("overwrite").parquet(f"{path}/text")
    cleaned.drop(text).write.mode("overwrite").json(f"{path}/report")


def filtered_lines(df: DataFrame, name: str, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, line_no, line): what one filter keeps, counted anew."""
    kept = df.select(*keys, F.posexplode(FILTERS[name](split_lines(F.col(text)))).alias("pos", "line"))
    return kept.select(*keys, (F.col("pos") + 1).alias("line_no"), "line")
