"""Regular series per key: differences, robust scores, rolling medians, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import selection
from tidemark.sources.tables import cut


def difference(value: str, keys: list[str], order: list[str]) -> Column:
    """First difference, 0 at the first row."""
    return F.coalesce(F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)), F.lit(0.0))


def with_robust_z(df: DataFrame, keys: list[str], value: str, name: str = "z", floor: float = 1e-6) -> DataFrame:
    """(x - median) / (1.4826 * MAD + floor) per key, by selection for keys of any size; df is written once and read from there."""
    near = cut(selection.with_percentiles(cut(df, "series"), keys, value, [0.5], "_med"), "centred")
    spread = selection.with_percentiles(near, keys, F.abs(F.col(value) - F.col("_med")[0]), [0.5], "_mad")
    return spread.withColumn(name, (F.col(value) - F.col("_med")[0]) / (1.4826 * F.col("_mad")[0] + floor)).drop("_med", "_mad")


def rolling_median(value: str, keys: list[str], order: list[str], reach: int = 3) -> Column:
    """Median of the rows within reach, the ends repeated beyond the edges."""
    w = Window.partitionBy(*keys).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = [F.coalesce((F.lag(value, i) if s == "lag" else F.lead(value, i)).over(w), (F.first(value) if s == "lag" else F.last(value)).over(whole)) for s in ("lag", "lead") for i in range(1, reach + 1)]
    return F.get(F.array_sort(F.array(F.col(value), *near)), F.lit(reach))


def percentile_threshold(df: DataFrame, keys: list[str], value: str, order: list[str], low: float = 0.05, high: float = 0.95, share: float = 0.35) -> DataFrame:
    """Adds threshold = p_low + share * (p_high - p_low) per key and spread = p_high - p_low; the first row is left out."""
    rank = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    rank = cut(rank, "ranked")
    cuts = selection.percentiles(rank.filter("_n > 1"), keys, value, [low, high], "_p")
    spread = F.col("_p")[1] - F.col("_p")[0]
    return rank.drop("_n").join(cuts, keys).withColumns({"threshold": F.col("_p")[0] + share * spread, "spread": spread}).drop("_p")


def interpolate(value: str, time: str, keys: list[str]) -> Column:
    """value where it is set, else linear between its neighbours in time, beyond the ends the nearest one."""
    w = Window.partitionBy(*keys).orderBy(time)
    known = F.when(F.col(value).isNotNull(), F.struct(time, value))
    before = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    slope = (after[value] - before[value]) * (F.col(time) - before[time]) / F.when(after[time] > before[time], after[time] - before[time])
    return F.coalesce(before[value] + slope, before[value], after[value])


def decibel(samples: Column) -> Column:
    """Loudness of an array of samples: 20 log10(rms)."""
    mean_square = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x * x) / F.size(samples)
    return 20 * F.log10(F.sqrt(mean_square + 1e-12) + 1e-9)


def carry_forward(value: str, keys: list[str], order: list[str]) -> Column:
    """The last value that was set."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def redness(red: Column, green: Column, blue: Column) -> Column:
    """How much red stands out of a frame's mean colours."""
    return red - (blue + green) / 2
