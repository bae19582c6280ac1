"""Learned rhythms: a grid of period and phase through event starts, and what breaks it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def learn(df: DataFrame, keys: list[str], start: str, length: str, least_events: int = 4, refinements: int = 3, least_tolerance: float = 3.0) -> DataFrame:
    """Each event of a key with enough of them, with period, phase, usual (median length), cycle, deviation and reason.

    reason: early or late beyond max(0.2 period, least_tolerance), long or short beyond 1.8 or below 0.4 of usual; null on
    schedule. The medians are window aggregates over one key, so all passes share one shuffle.
    """
    whole = Window.partitionBy(*keys)
    order = whole.orderBy(start)
    median = lambda c: F.percentile(c, F.lit(0.5)).over(whole)
    step = df.withColumn("_step", F.col(start) - F.lag(start).over(order))
    rows = step.withColumns({"_n": F.count(F.lit(1)).over(whole), "period": median("_step"), "usual": median(length), "phase": F.min(start).over(whole).cast("double")})
    rows = rows.filter((F.col("_n") >= least_events) & (F.col("period") > 0))
    cycle = F.rint((F.col(start) - F.col("phase")) / F.col("period"))
    for _ in range(refinements):
        rows = rows.withColumn("_at", F.col(start) - cycle * F.col("period")).withColumn("phase", median("_at"))
    off = F.col(start) - (F.col("phase") + F.col("cycle") * F.col("period"))
    tolerance = F.greatest(0.2 * F.col("period"), F.lit(least_tolerance))
    timing = F.when(F.col("deviation") < -tolerance, "early").when(F.col("deviation") > tolerance, "late")
    lasting = F.when(F.col(length) > 1.8 * F.col("usual"), "long").when(F.col(length) < 0.4 * F.col("usual"), "short")
    judged = rows.withColumn("cycle", cycle).withColumn("deviation", off)
    text = F.concat_ws(" and ", timing, lasting)
    return judged.withColumn("reason", F.when(text != "", text)).drop("_step", "_n", "_at")


def summary(learned: DataFrame, keys: list[str]) -> DataFrame:
    """keys, period, usual, events, regular, unexpected."""
    odd = F.count("reason")
    return learned.groupBy(*keys).agg(F.first("period").alias("period"), F.first("usual").alias("usual"), F.count(F.lit(1)).alias("events"), (F.count(F.lit(1)) - odd).alias("regular"), odd.alias("unexpected"))
