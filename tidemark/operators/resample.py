"""Irregular key points on a regular grid, and what changes on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def on_grid(points: DataFrame, keys: list[str], time: str, values: list[str], step: int) -> DataFrame:
    """keys, time and values at every multiple of step between a key's first and last point, linear between neighbours.

    time is an integer. Each pair of neighbours makes the instants from the first one up to before the second, so a key's
    grid is spread over its pairs and nothing is joined; of points at one time the last by value counts.
    """
    w = Window.partitionBy(*keys).orderBy(time)
    one = points.groupBy(*keys, time).agg(F.max(F.struct(*values)).alias("_v")).withColumns({"_t1": F.lead(time).over(w), "_v1": F.lead("_v").over(w)})
    first = F.ceil(F.col(time) / F.lit(step)).cast("long")
    # up to before the next point; the last point of a key stands for itself
    last = F.when(F.col("_t1").isNull(), F.floor(F.col(time) / F.lit(step))).otherwise(F.ceil(F.col("_t1") / F.lit(step)) - 1).cast("long")
    ticks = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<long>"))
    rows = one.withColumn("_k", F.explode(ticks)).withColumn("_at", F.col("_k") * step)
    share = F.when(F.col("_t1").isNull(), 0.0).otherwise((F.col("_at") - F.col(time)) / (F.col("_t1") - F.col(time)))
    line = lambda v: F.col(f"_v.{v}") + F.coalesce(F.col(f"_v1.{v}") - F.col(f"_v.{v}"), F.lit(0.0)) * share
    return rows.select(*keys, F.col("_at").alias(time), *(line(v).alias(v) for v in values))


def changes(df: DataFrame, keys: list[str], time: str, flag: Column) -> DataFrame:
    """keys, time and `on` where a flag becomes true (a key's first row from nothing) or ceases to be."""
    w = Window.partitionBy(*keys).orderBy(time)
    marked = df.select(*keys, time, F.coalesce(flag, F.lit(False)).alias("on"))
    return marked.withColumn("_before", F.lag("on", 1, False).over(w)).filter(F.col("on") != F.col("_before")).drop("_before")
