"""Broadcasts behind a check of their size, and column names that can't clash with a caller's."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_BYTES = 32 << 20


def weight(df: DataFrame) -> int:
    """Bytes of the rows of ``df``, written as text; one pass over a table that is already written down."""
    row = F.to_json(F.struct("*")) if df.columns else F.lit("")
    return df.agg(F.coalesce(F.sum(F.octet_length(row)), F.lit(0)).alias("n")).first()["n"]


def small(df: DataFrame, limit: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``df`` to be broadcast if its measured bytes are at most ``limit``, else as it is, to be joined by shuffle. Rows are the same."""
    return F.broadcast(df) if weight(df) <= limit else df


def free(name: str, taken: Iterable[str]) -> str:
    """``name``, or a longer one that no column of ``taken`` has, whatever its case."""
    have = {x.lower() for x in taken}
    while name.lower() in have:
        name += "_"
    return name
