"""The corpus as lines: sources behind three-line fences, with a span of line numbers for each.

The running line number over all sources is a prefix sum in two levels: the sources' sizes are
range-partitioned by order and written down once, the partitions' sums (as many as there are
partitions) are added up, and each partition then adds its own offset. No window sees all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import split_lines
from lectern.operators.sanitize import MARKER, RULE

FENCE_LINES = 3


def fence(name: Column, path: Column) -> Column:
    return F.concat(F.lit(f"{RULE}\n{MARKER}"), name, F.lit(" (Path: "), path, F.lit(f")\n{RULE}\n"))


def running_total(df: DataFrame, order: list[str], size: str, into: str) -> DataFrame:
    """The columns of ``order`` and ``size``, with the sum of ``size`` over all rows before, in that order, as ``into``."""
    slim = df.select(*order, size).repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).withColumn("__part", F.spark_partition_id()).checkpoint()
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = slim.groupBy("__part").agg(F.sum(size).alias("__sum"))  # one row for each partition
    parts = parts.withColumn("__offset", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    own = Window.partitionBy("__part").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    return slim.join(F.broadcast(parts), "__part").withColumn(into, F.col("__offset") + F.coalesce(F.sum(size).over(own), F.lit(0))).drop("__part", "__offset")


def body_lines(text: Column) -> Column:
    """Line breaks of a source's body: a body that doesn't end in one gets one."""
    return F.regexp_count(text, F.lit("\n")) + F.when(text.endswith("\n"), 0).otherwise(1)


def block_size(text: Column) -> Column:
    """Lines of a source with its fence."""
    return (F.lit(FENCE_LINES) + body_lines(F.coalesce(text, F.lit("")))).cast("bigint")


def source_spans(df: DataFrame, order: list[str], text: str = "text", size: str | None = None) -> DataFrame:
    """The order columns, start_line and end_line of each source's body in the fenced corpus; ``size`` names a column of ``block_size``, if there is one."""
    sized = df.select(*order, (F.col(size) if size else block_size(F.col(text))).alias("__size"))
    total = running_total(sized, order, "__size", "__before")
    return total.select(*order, (F.col("__before") + FENCE_LINES + 1).alias("start_line"), (F.col("__before") + F.col("__size")).alias("end_line"))


def lines(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, line_no, line): a row for each line, counted from 1."""
    out = df.select(*keys, F.posexplode(split_lines(F.col(text))).alias("pos", "line"))
    return out.select(*keys, (F.col("pos") + 1).alias("line_no"), "line")


def slice_lines(rows: DataFrame, start: int, end: int) -> DataFrame:
    """Lines start to end of (line_no, line) rows, both included."""
    return rows.where(F.col("line_no").between(start, end))


SLICE = 4096


def slice_sources(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Lines (line_no, line) of the corpus with the columns of the span (start_line, end_line) they are in.

    A range join as an equi-join: both sides meet by blocks of ``SLICE`` lines, of which a span is in as many as it touches.
    """
    block = F.lit(SLICE).cast("bigint")
    first, last = F.expr(f"start_line div {SLICE}"), F.expr(f"end_line div {SLICE}")
    held = spans.where("start_line <= end_line").withColumn("__block", F.explode(F.sequence(first, last)))
    near = rows.withColumn("__block", F.floor(F.col("line_no") / block).cast("bigint")).join(held, "__block")
    return near.where(F.col("line_no").between(F.col("start_line"), F.col("end_line"))).drop("__block")


def fenced_blocks(df: DataFrame, name: Column, path: Column, text: Column) -> DataFrame:
    """``df`` with ``block``: the source behind its fence, ending in a line break."""
    body = F.when(text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n")))
    return df.withColumn("block", F.concat(fence(name, path), body))


def concat_ordered(df: DataFrame, keys: list[str], order: list[str], value: str, separator: str, into: str = "text") -> DataFrame:
    """One row for each key: the values in order, joined."""
    got = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, value))).alias("__all"))
    return got.select(*keys, F.array_join(F.transform("__all", lambda x: x[value]), separator).alias(into))


def write_lines(df: DataFrame, keys: list[str], path: str, text: str = "text") -> None:
    """The corpus as a table: lines by source, written in parallel. This is the form to work with."""
    lines(df, keys, text).write.mode("overwrite").parquet(path)


def write_corpus(blocks: DataFrame, order: list[str], path: str) -> None:
    """The corpus as text: blocks in order, in files whose names are in that order too, so that joined they are one text."""
    rows = blocks.orderBy(*order).select(F.regexp_replace("block", r"\n\z", "").alias("value"))
    rows.write.mode("overwrite").text(path)
