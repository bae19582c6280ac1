"""Runs and segments of ordered observations: gaps and islands, hysteresis and de-noising.

All windows share one partitioning and order, so a chain of these operators shuffles and sorts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _ordered(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def _running(keys: list[str], order: list[str]):
    return _ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)


def with_run(df: DataFrame, keys: list[str], order: list[str], flag: str, name: str = "run") -> DataFrame:
    """Numbers the maximal runs of equal flags from 0 (null is a value of its own)."""
    w = _ordered(keys, order)
    changes = F.when(F.row_number().over(w) == 1, 0).when(F.lag(flag).over(w).eqNullSafe(F.col(flag)), 0).otherwise(1)
    return df.withColumn("_change", changes).withColumn(name, F.sum("_change").over(_running(keys, order))).drop("_change")


def with_segment(df: DataFrame, keys: list[str], order: list[str], time: str, gap: float, name: str = "seg") -> DataFrame:
    """Numbers segments from 0; a new one begins where the time since the row before exceeds gap."""
    w = _ordered(keys, order)
    opens = F.when(F.col(time) - F.lag(time).over(w) > gap, 1).otherwise(0)
    return df.withColumn("_open", opens).withColumn(name, F.sum("_open").over(_running(keys, order))).drop("_open")


def runs(df: DataFrame, keys: list[str], order: list[str], flag: str, time: str) -> DataFrame:
    """keys, run, flag, t0, t1 and n of every run: run-length encoding."""
    marked = with_run(df, keys, order, flag)
    return marked.groupBy(*keys, "run").agg(F.first(flag).alias(flag), F.min(time).alias("t0"), F.max(time).alias("t1"), F.count(F.lit(1)).alias("n"))


def segments(df: DataFrame, keys: list[str], order: list[str], time: str, gap: float) -> DataFrame:
    """keys, seg, t0, t1 and n of every segment."""
    marked = with_segment(df, keys, order, time, gap)
    return marked.groupBy(*keys, "seg").agg(F.min(time).alias("t0"), F.max(time).alias("t1"), F.count(F.lit(1)).alias("n"))


def flip_short_runs(df: DataFrame, keys: list[str], order: list[str], flag: str, time: str, least: float, step: float | Column = 0.0, only: bool | None = None) -> DataFrame:
    """Hysteresis: interior runs with t1 - t0 + step < least get the other flag, all judged by the runs as they were.

    only: flip just runs of this value. The first and last run of a key stay.
    """
    marked = with_run(df, keys, order, flag, "_run")
    inside = Window.partitionBy(*keys, "_run")
    whole = Window.partitionBy(*keys)
    length = F.max(time).over(inside) - F.min(time).over(inside) + (step if isinstance(step, Column) else F.lit(step))
    # by whole partitions, so each row sees its run and the last run of its key
    judged = marked.withColumns({"_length": length, "_last": F.max("_run").over(whole)})
    short = (F.col("_run") > 0) & (F.col("_run") < F.col("_last")) & (F.col("_length") < least)
    if only is not None:
        short &= F.col(flag) == only
    return judged.withColumn(flag, F.col(flag) != short).drop("_run", "_length", "_last")


def flip_short_spans(spans: DataFrame, keys: list[str], start: str, end: str, flag: str, least: float, step: float | Column = 0.0) -> DataFrame:
    """flip_short_runs where the maximal runs of a key are rows already: those between others with end - start + step < least get
    the other flag."""
    w = _ordered(keys, [start])
    inner = F.lag(F.lit(1)).over(w).isNotNull() & F.lead(F.lit(1)).over(w).isNotNull()
    short = inner & (F.col(end) - F.col(start) + (step if isinstance(step, Column) else F.lit(step)) < least)
    return spans.withColumn("_short", short).withColumn(flag, F.col(flag) != F.col("_short")).drop("_short")


def denoise(df: DataFrame, keys: list[str], order: list[str], flag: str, time: str, fill: float, drop: float) -> DataFrame:
    """Two passes: the first flag copies the second; short False runs are filled, then short True runs dropped."""
    w = _ordered(keys, order)
    first = F.when(F.row_number().over(w) == 1, F.coalesce(F.lead(flag).over(w), F.col(flag))).otherwise(F.col(flag))
    filled = flip_short_runs(df.withColumn(flag, first), keys, order, flag, time, fill, only=False)
    return flip_short_runs(filled, keys, order, flag, time, drop, only=True)


def dilate(flag: str, keys: list[str], order: list[str], reach: int = 2) -> Column:
    """True where any flag within `reach` rows is."""
    return F.coalesce(F.max(F.col(flag).cast("int")).over(_ordered(keys, order).rowsBetween(-reach, reach)) > 0, F.lit(False))


def bridge_one_gap(flag: str, keys: list[str], order: list[str]) -> Column:
    """A single unset row between two set ones counts as set."""
    w = _ordered(keys, order)
    return F.col(flag) | (F.coalesce(F.lag(flag).over(w), F.lit(False)) & F.coalesce(F.lead(flag).over(w), F.lit(False)))


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a total order."""
    return nth(df, keys, order, 1)


def nth(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rank") == n).drop("_rank")


def top(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rank") <= n).drop("_rank")
