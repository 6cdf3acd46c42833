"""Broadcast a side only after measuring it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A hash relation of this many measured bytes is safe on the driver and on every executor.
BROADCAST_LIMIT_BYTES = 128 * 1024 * 1024
# Header, key and pointer of one row in a hash relation.
ROW_OVERHEAD_BYTES = 64


def measured_bytes(df: DataFrame, payload: Column) -> int:
    """Bytes `df` takes as a hash relation: one aggregate over the given payload size."""
    row = df.agg(
        F.count("*").alias("n"), F.coalesce(F.sum(payload), F.lit(0)).alias("bytes")
    ).first()
    return int(row["n"]) * ROW_OVERHEAD_BYTES + int(row["bytes"])


def fits_broadcast(df: DataFrame, payload: Column, limit: int = BROADCAST_LIMIT_BYTES) -> bool:
    """Whether `df` is proven small enough to broadcast."""
    return measured_bytes(df, payload) <= limit
