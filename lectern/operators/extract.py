"""Documents measured and placed in the corpus: the ``sources`` and ``failures`` tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import count_words, estimate_tokens, file_format, file_name, page_estimate
from lectern.operators.lines import block_size, running_total, source_spans
from lectern.operators.sanitize import sanitize
from lectern.operators.structure import detect_structure

COST_FACTOR, READ_FACTOR, RETAINED_BAND = 1.3, 4, (50, 70)


def measure(df: DataFrame, text: str = "text", pages: str | None = None, strict: bool = False) -> DataFrame:
    """``df`` with chars, words, estimated_tokens, pages, chapters, has_toc (and headings)."""
    value = F.coalesce(F.col(text), F.lit(""))
    df = detect_structure(df, text, strict)
    return df.withColumns({
        "chars": F.length(value),
        "words": count_words(value),
        "estimated_tokens": estimate_tokens(value),
        "pages": page_estimate(F.length(value), F.col(pages) if pages else None),
    })


def placed(df: DataFrame, order: list[str], pages: str | None = None, text: str = "text", strict: bool = False) -> DataFrame:
    """``df`` without its text, measured, with its span in the corpus. Texts are read once; only their measures are written down and ordered."""
    sized = measure(df, text, pages, strict).withColumn("__lines", block_size(F.col(text))).drop("headings", text).withColumnRenamed("chapters", "chapters_detected").checkpoint()
    return sized.join(source_spans(sized, order, size="__lines"), order).drop("__lines")


def extract(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources, failures) of parsed files (seq, path, text, pages, error); sources keep their sanitised text."""
    named = parsed.withColumns({"filename": file_name(F.col("path")), "format": file_format(F.col("path"))})
    good = named.where("error is null").drop("error").withColumn("text", sanitize(F.coalesce("text", F.lit("")))).checkpoint()
    sources = placed(good.withColumnRenamed("pages", "own_pages"), ["seq"], "own_pages").drop("own_pages").join(good.select("seq", "text"), "seq")
    failures = named.where("error is not null").select("seq", "filename", "path", "format", F.col("error"))
    return sources, failures


def total_cost(sources: DataFrame) -> DataFrame:
    """(total_sources, total_tokens, cost_tokens): what reading the whole corpus takes."""
    total = F.coalesce(F.sum("estimated_tokens"), F.lit(0))
    return sources.agg(F.count("*").alias("total_sources"), total.alias("total_tokens"), (total * F.lit(COST_FACTOR)).alias("cost_tokens"))


def metadata_json(sources: DataFrame, failures: DataFrame, mode: str = "text") -> DataFrame:
    """One row, one JSON document: totals and the records. For libraries, not for web-sized corpora: use the tables there."""
    def packed(df: DataFrame) -> DataFrame:
        cols = [c for c in df.columns if c != "text"]
        return df.agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("a"), F.count("*").alias("n"))

    s, f = packed(sources.select("seq", *[c for c in sources.columns if c not in ("seq", "text")])), packed(failures)
    both = s.select(F.col("a").alias("sources"), "n").crossJoin(f.select(F.col("a").alias("failures")))
    return both.select(F.to_json(F.struct(F.col("n").alias("total_sources"), F.lit(mode).alias("mode"), F.lit("script-density").alias("token_method"), "sources", "failures")).alias("metadata"))


def input_gate(slices: DataFrame, order: list[str], tokens: str, output_budget: int) -> DataFrame:
    """(order, tokens, read, within): tokens read up to and with each slice, and whether that is at most ``READ_FACTOR`` output budgets."""
    total = running_total(slices.withColumn(tokens, F.col(tokens).cast("bigint")), order, tokens, "__before")
    out = total.withColumn("read", F.col("__before") + F.col(tokens)).drop("__before")
    return out.withColumn("within", F.col("read") <= READ_FACTOR * output_budget)


def tokens_per_item(df: DataFrame, tokens: str, items: str) -> DataFrame:
    """``df`` with per_item (null without items) and in_band."""
    out = df.withColumn("per_item", F.when(F.col(items) > 0, F.col(tokens) / F.col(items)))
    return out.withColumn("in_band", F.col("per_item").between(*RETAINED_BAND))


def resolve_source(sources: DataFrame, name: str) -> DataFrame:
    """The sources that a name means: by file name or by path."""
    return sources.where((F.col("filename") == name) | (F.col("path") == name))
