"""Exact percentiles of keys of any size, by distributed selection.

Spark's own percentile keeps all different values of a key in one task, and a window all its rows. Here that is done only for
keys of at most GATHER rows. For larger ones a rank is narrowed down in rounds: a sketch proposes five values around it, one
pass counts exactly how many rows lie below and at each, and only the open interval between two of them that holds the rank
goes on, until it has GATHER rows at most or the rank falls on a value itself. The proposals are values of the rows, so ties
of any size end the search at once and every round leaves rows behind; the sketch only decides how few, never the result.
Each round is partial sums over all rows of a key in all its tasks: nothing but counts is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.tables import cut

#: Rows of a key, or of what is left of it, that one task may hold, and the steps of the sketch.
GATHER, STEPS = 100_000, 256


def _same(keys: list[str], a: str, b: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out &= F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def _inside(rows: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of each span: keys, rank, and _v between lo and hi, which don't belong to it."""
    open_ = (F.col("lo").isNull() | (F.col("_v") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("_v") < F.col("hi")))
    return rows.alias("l").join(spans.alias("r"), _same(keys, "l", "r") & open_).select("r.*", "_v")


def _narrowed(rows: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans with their rank's value, or with fewer rows."""
    names = spans.columns
    sketch = _inside(rows, spans, keys).groupBy(*names).agg(F.percentile_approx("_v", F.array(*(F.lit(i / STEPS) for i in range(STEPS + 1))), F.lit(20 * STEPS)).alias("_s"))
    at = F.floor((F.col("rank") - F.col("below")) / F.col("inside") * STEPS).cast("int")
    pick = lambda d: F.get("_s", F.greatest(F.lit(0), F.least(F.lit(STEPS), at + d)))
    asked = cut(sketch.select(*names, F.array_sort(F.array_distinct(F.array(*map(pick, (-1, 0, 1, 2, 3))))).alias("pivots")), "pivots")
    each = _inside(rows, asked, keys)
    n = 5
    below, upto = ([F.sum(F.when(test(F.get("pivots", F.lit(i))), 1).otherwise(0)) for i in range(n)] for test in (lambda p: F.col("_v") < p, lambda p: F.col("_v") <= p))
    counted = each.groupBy(*names, "pivots").agg(F.array(*below).alias("lt"), F.array(*upto).alias("le"))
    t, size = F.col("rank") - F.col("below"), F.size("pivots")
    at = lambda c, i: F.get(c, F.lit(i))
    found = F.coalesce(*(F.when((at("lt", i) <= t) & (t < at("le", i)), at("pivots", i)) for i in range(n)))
    passed = sum((F.when((i < size) & (at("le", i) <= t), 1).otherwise(0) for i in range(n)), F.lit(0))  # pivots below the rank
    judged = counted.withColumns({"found": found, "_passed": passed})
    before, after = F.col("_passed") - 1, F.col("_passed")
    under = F.when(after > 0, F.get("le", before)).otherwise(F.lit(0).cast("long"))
    upto_next = F.when(after < size, F.get("lt", after)).otherwise(F.col("inside"))
    return judged.select(*keys, "rank", "n", F.coalesce(F.when(after > 0, F.get("pivots", before)), "lo").alias("lo"), F.coalesce(F.when(after < size, F.get("pivots", after)), "hi").alias("hi"), (F.col("below") + under).alias("below"), (upto_next - under).alias("inside"), "found")


def _selected(rows: DataFrame, sizes: DataFrame, keys: list[str], fractions: Sequence[float], most: int) -> DataFrame:
    """keys, n, rank and found for the ranks around each fraction of large keys."""
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor((F.col("n") - 1) * p), F.ceil((F.col("n") - 1) * p)) for p in fractions))))
    kind = rows.schema["_v"].dataType
    none = F.lit(None).cast(kind)
    spans = cut(sizes.select(*keys, "n", F.explode(ranks).alias("rank"), none.alias("lo"), none.alias("hi"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside")), "spans")
    done = []
    while True:
        wide, few = spans.filter(F.col("inside") > most), spans.filter(F.col("inside") <= most)
        held = _inside(rows, few, keys).groupBy(*few.columns).agg(F.sort_array(F.collect_list("_v")).alias("_all"))
        done.append(held.select(*keys, "n", "rank", F.get("_all", (F.col("rank") - F.col("below")).cast("int")).alias("found")))
        if wide.isEmpty():
            break
        found = cut(_narrowed(rows, wide, keys), "spans")
        done.append(found.filter("found IS NOT NULL").select(*keys, "n", "rank", "found"))
        spans = found.filter("found IS NULL").drop("found")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def percentiles(df: DataFrame, keys: list[str], value: str | Column, fractions: Sequence[float], name: str = "p", most: int = GATHER) -> DataFrame:
    """keys and an array of the percentiles of value, exact and with linear interpolation, as Spark's percentile gives them.

    Nulls don't count; a key without values has none. df is read once for the sizes and once for each round.
    """
    rows = df.select(*keys, (F.col(value) if isinstance(value, str) else value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    plain = lambda r: r.groupBy(*keys).agg(F.percentile("_v", F.array(*map(F.lit, fractions))).alias(name))
    large = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most), "sizes")
    if large.isEmpty():
        return plain(rows)
    small = plain(rows.alias("l").join(large.alias("r"), _same(keys, "l", "r"), "left_anti"))
    rows = rows.alias("l").join(large.alias("r"), _same(keys, "l", "r"), "left_semi")
    by = _selected(rows, large, keys, fractions, most).groupBy(*keys, "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "found"))).alias("_m"))

    def between(p: float) -> Column:
        at = (F.col("n") - 1) * p
        low, high = F.floor(at), F.ceil(at)
        a, b = F.col("_m")[low], F.col("_m")[high]
        return F.when((low == high) | (a == b), a).otherwise((high - at) * a + (at - low) * b)

    return small.unionByName(by.select(*keys, F.array(*map(between, fractions)).alias(name)))


def with_percentiles(df: DataFrame, keys: list[str], value: str | Column, fractions: Sequence[float], name: str = "p", most: int = GATHER) -> DataFrame:
    """df with the percentiles of its key; null where the key has no values."""
    found = percentiles(df, keys, value, fractions, "_found_p", most).select(*(F.col(k).alias(f"_k_{k}") for k in keys), "_found_p")
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(found, on, "left").withColumn(name, F.col("_found_p")).drop("_found_p", *(f"_k_{k}" for k in keys))
