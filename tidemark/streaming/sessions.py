"""Streaming forms: sessions and hourly counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(df: DataFrame, key: str, time: str, gap: str, late: str = "1 hour") -> DataFrame:
    """key, t0, t1 and n of each session, for batches and streams alike; time zone-less times become timestamps first."""
    rows = df.withColumn(time, F.col(time).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark(time, late)
    return rows.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.min(time).alias("t0"), F.max(time).alias("t1"), F.count(F.lit(1)).alias("n")).select(key, "t0", "t1", "n")


def hourly_counts(df: DataFrame, time: str, label: str, late: str = "1 hour") -> DataFrame:
    """Counts per hour and label, with a watermark on streams."""
    rows = df.withColumn(time, F.col(time).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark(time, late)
    return rows.groupBy(F.window(time, "1 hour").alias("w"), label).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("hour"), label, "n")
