"""As-of, nearest and band joins per key. As-of is a union and one window: no range join, linear after the sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof(left: DataFrame, right: DataFrame, keys: list[str], time: str, take: list[str], forward: bool = False, strict: bool = False, tolerance: float | None = None, clamp: bool = False) -> DataFrame:
    """left with `take` of the last row of right at or before its time (forward: the first at or after); nulls where none.

    strict: never at the same time. tolerance: not further than that. clamp: past the other end, its last row. Rows of right
    at the same time: the one greatest (forward: least) in `take` counts.
    """
    value = F.struct(F.col(time).alias("_at"), *take)
    rows = right.select(*keys, F.col(time).alias("_t"), F.lit(1).alias("_right"), value.alias("_value"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_left"))
    asks = left.select(*keys, F.col(time).alias("_t"), F.lit(0).alias("_right"), F.lit(None).cast(rows.schema["_value"].dataType).alias("_value"), F.struct(*left.columns).alias("_left"))
    sign = -1 if forward else 1
    tie = (1 - F.col("_right")) if not strict else F.col("_right")
    # in the direction of travel: what may be taken at the same time comes first
    w = Window.partitionBy(*keys).orderBy("_along", "_tie", F.col("_value").desc() if forward else F.col("_value").asc())
    found = F.last("_value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    both = rows.unionByName(asks).withColumns({"_along": F.col("_t") * sign, "_tie": tie}).withColumn("_found", found)
    if clamp:
        # nothing was found up to here, so the first value of the key is the first one from here on: a frame that is the same for
        # all rows is run through once, one that ends at the last row anew for each row
        edge = F.first("_value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        both = both.withColumn("_found", F.coalesce("_found", edge))
    out = both.filter("_right = 0")
    if tolerance is not None:
        out = out.withColumn("_found", F.when(F.abs(F.col("_found._at") - F.col("_t")) <= tolerance, F.col("_found")))
    return out.select("_left.*", F.col("_found._at").alias("at"), *(F.col(f"_found.{c}").alias(f"found_{c}") for c in take))


def band(left: DataFrame, right: DataFrame, keys: list[str], time: str, below: int, above: int, take: list[str]) -> DataFrame:
    """Pairs with right's time in [left's - below, left's + above]: buckets of the band's width make it an equi-join."""
    size = max(1, below + above)
    l_buckets = F.sequence(F.floor((F.col(time) - below) / size).cast("long"), F.floor((F.col(time) + above) / size).cast("long"))
    asks = left.withColumn("_bucket", F.explode(l_buckets))
    rows = right.select(*keys, F.col(time).alias("at"), *(F.col(c).alias(f"found_{c}") for c in take), F.floor(F.col(time) / size).cast("long").alias("_bucket"))
    return asks.join(rows, [*keys, "_bucket"]).filter((F.col("at") >= F.col(time) - below) & (F.col("at") <= F.col(time) + above)).drop("_bucket")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], time: str, row: list[str], take: list[str], below: int, above: int, distance: Column | None = None) -> DataFrame:
    """One row per left row (named by `row`) with a partner in the band: the least distance, then time, then take."""
    far = distance if distance is not None else F.abs(F.col("at") - F.col(time))
    pairs = band(left, right, keys, time, below, above, take).withColumn("_far", far)
    best = F.min(F.struct("_far", "at", *(f"found_{c}" for c in take))).alias("b")
    return pairs.groupBy(*dict.fromkeys([*keys, *row, time])).agg(best).select(*dict.fromkeys([*keys, *row, time]), F.col("b._far").alias("distance"), "b.at", *(F.col(f"b.found_{c}").alias(f"found_{c}") for c in take))
