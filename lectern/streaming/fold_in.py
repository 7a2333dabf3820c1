"""Incremental growth of a library: new sources are measured and appended as they arrive.

A file stream with ``availableNow`` takes what has arrived since the last call and stops; the
stream's checkpoint is the set of sources already folded in. Spans stay relative to the batch that
brought a source, so a batch never rewrites what stands: the corpus line of a source is its own
line plus the lines of the batches before it, which ``with_offsets`` adds from one sum per batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.operators.extract import measure
from lectern.operators.lines import body_lines, source_spans
from lectern.operators.sanitize import sanitize


def measured_batch(docs: DataFrame, order: list[str]) -> DataFrame:
    """Sanitised and measured documents of one batch, with spans inside the batch."""
    clean = docs.withColumn("text", sanitize(F.coalesce("text", F.lit("")))).checkpoint()
    sized = measure(clean).drop("headings")
    return sized.withColumn("lines", F.lit(3) + body_lines(F.col("text"))).join(source_spans(clean, order), order)


def fold_in(spark: SparkSession, arrivals: str, schema: StructType, target: str, checkpoint: str, order: list[str] | None = None) -> None:
    """Appends what has arrived in ``arrivals`` (Parquet) to ``target``, one folder for each batch; a batch that is run again replaces its folder."""
    keys = order or ["doc_id"]

    def write(batch: DataFrame, batch_id: int) -> None:
        measured_batch(batch, keys).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    stream = spark.readStream.schema(schema).parquet(arrivals)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def with_offsets(folded: DataFrame) -> DataFrame:
    """Corpus-wide start_line and end_line: the batches' lines before each batch are added to its own."""
    sums = folded.groupBy("batch").agg(F.sum("lines").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("batch", before.alias("__offset"))  # one row for each batch
    return folded.join(offsets, "batch").withColumns({"start_line": F.col("start_line") + F.col("__offset"), "end_line": F.col("end_line") + F.col("__offset")}).drop("__offset")


def duplicates_dropped(stream: DataFrame, key: str, event_time: str, late: str = "1 day") -> DataFrame:
    """A stream in which each key passes once within the watermark."""
    return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark([key])
