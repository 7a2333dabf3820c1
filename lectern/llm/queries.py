"""One query per training-data operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import bpe, chat, fingerprints, licenses, media, mixing, near_dup, pii, suffix_dedup, toxicity
from lectern.session import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.document_fingerprints(table(spark, sf_dir, "documents"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "pages"), "page_id", "html", media.new_folder(spark), keep=("url",))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), VOCABULARY)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.expand(table(spark, sf_dir, "conversations"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_document_fingerprints": op1_document_fingerprints,
    "op2_media_columns": op2_media_columns,
    "op3_toxicity": op3_toxicity,
    "op4_byte_level_bpe": op4_byte_level_bpe,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_source_mixing": op7_source_mixing,
    "op8_pii": op8_pii,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_license_scan": op10_license_scan,
}

ORACLES: dict[str, str] = {
    "op6_chat_formatting": chat.SQL,
    "op7_source_mixing": mixing.SQL,
}
