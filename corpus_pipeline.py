"""From raw documents to tokens: toxicity, near duplicates, personal data, mixing, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the
columns of ``documents``. ``run`` applies them in order and writes each result to the shared
folder before the next stage reads it, so a stage that scans its input twice never computes
its predecessors again, and a lost executor costs no more than the stage at hand. A stage's
input goes once its output stands.

Defined cases, each as the stage's operator has it: a null or empty text is never toxic, has no near
duplicate and no private span, and is left out by the mix, since it has no tokens; a null doc_id passes
the filters and is mixed under the number -1; texts of any length are judged, compared, redacted and
encoded whole; rows that repeat doc_id and text are one document to the near-duplicate filter; ties go
to the smallest doc_id; empty tables give an empty result; further columns, whatever their names, pass
through all stages but the last, which keeps doc_id, lang and source.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import bpe, mixing, near_dup, pii, toxicity
from lectern.llm.queries import VOCABULARY
from lectern.session import prepare, shared_dir, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier trained on ``labels`` rejects go."""
    return toxicity.reject_toxic(docs, table(prepare(spark), sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    prepare(spark)
    return near_dup.drop_near_duplicates(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Private spans are replaced by their kind."""
    prepare(spark)
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights in tokens of the vocabulary; a document taken in several epochs is several rows."""
    prepare(spark)
    counted = bpe.count(docs, VOCABULARY, ("doc_id", "lang", "source"))
    return mixing.select_mix(docs, counted=counted, tokens="n_tokens")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row."""
    prepare(spark)
    return bpe.encode(docs, VOCABULARY, ("doc_id", "lang", "source"))


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("pii", private),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: Training, graph components and byte-pair merging have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                _remove(spark, f"{folder}/{k - 1}")  # nothing reads it any more
    return docs
