"""Exact percentiles against Spark's own, for keys that one task must not hold."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import selection

FRACTIONS = (0.0, 0.05, 0.5, 0.731, 0.95, 1.0)


def both(rows, most):
    got = {r.k: r.p for r in selection.percentiles(rows, ["k"], "v", FRACTIONS, most=most).collect()}
    want = {r.k: r.p for r in rows.filter("v IS NOT NULL").groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, FRACTIONS))).alias("p")).collect()}
    return got, want


@pytest.mark.parametrize("most", [50, 1_000])
def test_equals_percentile_on_odd_distributions(spark, most):
    x = F.rand(3)
    shapes = {"even": x, "ties": F.floor(x * 3), "one value": F.lit(7.0), "wide": F.exp(x * 600 - 300), "mostly zero": F.when(x < 0.99, 0.0).otherwise(x), "signs": F.pow(x - 0.5, 9.0), "halves null": F.when(x < 0.5, x), "infinite": F.when(x < 0.3, float("-inf")).when(x > 0.7, float("inf")).otherwise(x)}
    value = F.lit(None).cast("double")
    for name, v in shapes.items():
        value = F.when(F.col("k") == name, v).otherwise(value)
    names = F.array(*(F.lit(n) for n in [*shapes, "empty"]), F.lit(None))
    rows = spark.range(30_000).select(F.get(names, (F.col("id") % 10).cast("int")).alias("k"), F.col("id")).withColumn("v", value).persist()
    few = spark.createDataFrame([("small", 1.0), ("small", 2.0), ("single", -4.0), (None, 3.0)], "k string, v double")
    got, want = both(rows.select("k", "v").unionByName(few), most)
    rows.unpersist()
    assert got == want and len(got) == 11


def test_a_key_of_a_million_rows_is_spread_over_tasks(spark):
    rows = spark.range(0, 1_000_000, 1, 8).select(F.lit("hot").alias("k"), (F.pmod(F.xxhash64("id"), F.lit(400_000)) / 7).alias("v"))
    got, want = both(rows, 20_000)
    assert got == want


def test_joined_back(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), ("b", None)], "k string, v double")
    got = {(r.k, r.v): r.p for r in selection.with_percentiles(rows, ["k"], "v", [0.5]).collect()}
    assert got == {("a", 1.0): [2.0], ("a", 3.0): [2.0], (None, 5.0): [5.0], ("b", None): None}
