"""Broadcasts behind a size check, and cut lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsift.session import shared_dir

MAX_BROADCAST_ROWS = 1_000_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def is_small(df: DataFrame, rows: int = MAX_BROADCAST_ROWS, size: int = MAX_BROADCAST_BYTES) -> bool:
    """Measure a query-side table: at most so many rows and so much text.

    Reads no further than the row bound. Meant for tables made from the
    queries, never for corpus rows.
    """
    seen = df.limit(rows + 1).select(F.octet_length(F.to_json(F.struct("*"))).alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes")
    ).first()
    return seen["n"] <= rows and seen["bytes"] <= size


def hinted(df: DataFrame, small: bool) -> DataFrame:
    """Broadcast what was found small; anything larger is joined by shuffle with skew handling."""
    return F.broadcast(df) if small else df


def materialized(df: DataFrame) -> DataFrame:
    """Compute once and keep in the shared folder, so that reuse survives lost executors."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)
