"""Session helpers: settings the engine relies on, read from the session before anything is set."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parent.parent)
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Make the package importable in Python workers, bound Arrow batches, and give checkpoints a folder.

    ``spark.checkpoint.dir`` is the shared folder of a cluster and is left alone where it is set;
    only a local session without one (tests) gets a temporary folder, a cluster without one is refused.
    """
    sc = spark.sparkContext
    paths = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lectern-checkpoint-"))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``, or the one ``prepare`` has set."""
    prepare(spark)
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


MAX_BROADCAST_BYTES = 32 << 20


def bounded(df: DataFrame, limit: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``df``, a table that is already written down, to be broadcast if its measured bytes are at most ``limit``."""
    size = df.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("n")).first()["n"]
    return F.broadcast(df) if size <= limit else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its scan has fewer splits than there are; larger inputs are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def once(df: DataFrame, keys: list[str], **made: Column) -> DataFrame:
    """``keys`` and the columns of ``made``, which are computed once a row: what filters, joins or names them later doesn't write them out again, and what they are made of isn't carried along."""
    return df.select(*keys, F.inline_outer(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
