"""Operator 9: mixing sources to target weights by subset-sum budget fitting.

Every source gets whole repeats of all its documents as far as its target allows; for the remaining budget, documents are
counted by exact length and a bounded knapsack chooses how many of each length to take once more. Within a length the
documents with the least seeded hash of all their columns are taken, so reruns agree.

The knapsack is solved to its optimum, a sum nearest to the whole remaining budget. Its table of
reachable sums covers the last words of the budget, the rest is given to each length in proportion; if no sum there is as
near as the lengths' common divisor allows, which proves it the nearest of all, the table is made four times as large, in
the end as large as the budget.

Nulls and empties: a null text has size 0 and takes no words; a null source is a source of its own, last in order. Ties:
rows equal in all columns have equal hashes, and of n such rows exactly as many as are needed are taken. Very long texts are
a length like others; an empty table gives an empty result. Further columns take part in the hash alone.
"""

from __future__ import annotations

from functools import reduce
from math import gcd

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import SPACE_CLASS, whole_text, write_table

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SEED = 20_011
#: Words that the knapsack's first table covers; it grows until its sum is proven the nearest.
FIRST_WORDS = 1 << 15
#: Bits of the seeded hash that a group of equal length is narrowed by at a time when its documents are ranked.
PREFIX_BITS = 8
#: Equal rows that are made from one count at a time.
CHUNK_ROWS = 10_000


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> dict[str | None, float]:
    """Each source's share of all words by weight, stopped at `most` times its size, the excess shared again."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, active, out = float(sum(sizes.values())), list(names), {}
    while active:
        total = sum(weight[s] for s in active)
        over = [s for s in active if left * weight[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in active}
        for s in over:
            out[s] = float(most * sizes[s])
        left -= sum(out[s] for s in over)
        active = [s for s in active if s not in over]
    return out


def knapsack(available: list[tuple[int, int]], budget: int) -> dict[int, int]:
    """How many of each length to take for a sum nearest to budget (the lower of two); bounded, exact.

    The reachable sums are the bits of one integer, each length comes in binary parts of its count, and the search ends
    as soon as the budget itself is reachable.
    """
    if budget <= 0:
        return {}
    limit = (1 << (2 * budget + 1)) - 1
    reach, steps = 1, []
    for length, count in available:
        if not 0 < length <= 2 * budget:
            continue
        part, left = 1, min(count, 2 * budget // length)
        while left and not reach >> budget & 1:
            now = min(part, left)
            steps.append((length, now, reach))
            reach |= (reach << length * now) & limit
            left, part = left - now, part * 2
        if reach >> budget & 1:
            break
    low = (reach & ((1 << budget + 1) - 1)).bit_length() - 1
    high_bits = reach >> budget
    high = budget + ((high_bits & -high_bits).bit_length() - 1) if high_bits else None
    at = low if high is None or budget - low <= high - budget else high
    out: dict[int, int] = {}
    for length, now, before in reversed(steps):
        if not before >> at & 1:
            at -= length * now
            out[length] = out.get(length, 0) + now
    return out


def nearest_sum(histogram: list[tuple[int, int]], budget: int, first_words: int = FIRST_WORDS) -> dict[int, int]:
    """How many documents of each length make a sum nearest to budget; exact for any budget.

    Sums are multiples of the lengths' common divisor, so one that misses the budget by its remainder can't be beaten. The
    knapsack fits the last words of the budget, after a share in proportion, and gets more of it until that is reached.
    """
    items = sorted(((x, n) for x, n in histogram if x > 0 and n > 0), reverse=True)
    size, unit = sum(x * n for x, n in items), reduce(gcd, (x for x, _ in items), 0)
    if budget <= 0 or not items:
        return {}
    if budget >= size:
        return dict(items)
    least = min(budget % unit, unit - budget % unit)
    words = first_words * unit
    while True:
        whole = words >= budget
        taken = {} if whole else {x: n * (budget - words) // size for x, n in items}
        left = budget - sum(x * k for x, k in taken.items())
        for x, n in items:
            if not whole and left > 2 * words and (more := min(n - taken[x], (left - words) // x)) > 0:
                taken[x] += more
                left -= more * x
        spare = [(x // unit, n - taken.get(x, 0)) for x, n in items if n > taken.get(x, 0)]
        # in units: a budget between two multiples is asked at both
        found = [knapsack(spare, left // unit + up) for up in ((0, 1) if left % unit else (0,))]
        sums = [unit * sum(x * k for x, k in f.items()) for f in found]
        at = min(range(len(sums)), key=lambda i: (abs(left - sums[i]), sums[i]))
        if abs(left - sums[at]) == least or whole:
            return {x: k for x, _ in items if (k := taken.get(x, 0) + found[at].get(x // unit, 0))}
        words *= 4


def fit_budget(histogram: list[tuple[int, int]], target: float, most: int = MOST_REPEATS) -> tuple[int, dict[int, int]]:
    """Whole repeats of every document, and how many documents of each length are taken once more."""
    size = sum(x * n for x, n in histogram)
    if not size:
        return 0, {}
    repeats = min(most, int(target // size))
    budget = min(size, round(target - repeats * size)) if repeats < most else 0
    return repeats, nearest_sum(histogram, budget)


def sized(docs: DataFrame) -> DataFrame:
    """_row (a row of docs), doc_id, source, _m_size (words) and _m_hash (seeded, of all columns)."""
    plain = lambda f: not any(x in f.dataType.simpleString() for x in ("map<", "variant"))
    told = [F.col(f"`{f.name}`") if plain(f) else F.to_json(F.struct(F.col(f"`{f.name}`"))) for f in docs.schema.fields if f.name != "text"]
    size, hashed = F.regexp_count(whole_text(), F.lit(f"[^{SPACE_CLASS[1:]}+")).cast("long"), F.xxhash64(F.lit(SEED), *told, F.col("text").isNull(), whole_text())
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), "doc_id", "source", size.alias("_m_size"), hashed.alias("_m_hash"))


def _same(source: Column, size: Column) -> Column:
    return source.eqNullSafe(F.col("_s")) & (size == F.col("_z"))


def _cuts(narrow: DataFrame, plans: DataFrame) -> DataFrame:
    """_s, _z, at_hash, take and n of each source and length with an extra: documents with a hash below at_hash are taken
    once more, and of the n with this hash, take.

    The hash is found by its leading bits, PREFIX_BITS at a time: counts by prefix are summed up in order, and only rows of
    the prefix where the sum passes extra are counted at the next one. A window holds 256 counts of a key at most.
    """
    edge = plans.filter("extra > 0").select(F.col("source").alias("_s"), F.col("_m_size").alias("_z"), F.col("extra").alias("take"))
    rows, on = narrow, None
    for shift in range(64 - PREFIX_BITS, -1, -PREFIX_BITS):
        prefix = F.shiftright("_m_hash", shift)
        inside = rows.join(edge, _same(F.col("source"), F.col("_m_size")) if on is None else _same(F.col("source"), F.col("_m_size")) & (F.shiftright("_m_hash", on) == F.col("_prefix")))
        counts = inside.groupBy("_s", "_z", "take", prefix.alias("_next")).agg(F.count(F.lit(1)).alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("_s", "_z").orderBy("_next").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        edge = write_table(counts.withColumn("_before", before).filter("_before < take AND take <= _before + n").select("_s", "_z", (F.col("take") - F.col("_before")).alias("take"), F.col("_next").alias("_prefix"), "n"), "mix-prefix")
        on = shift
        # a prefix with a single document is as good as its whole hash
        if edge.filter("n > 1").isEmpty():
            break
    last = narrow.join(edge, _same(F.col("source"), F.col("_m_size")) & (F.shiftright("_m_hash", on) == F.col("_prefix")))
    return last.groupBy("_s", "_z", "take").agg(F.min("_m_hash").alias("at_hash"), F.count(F.lit(1)).alias("n"))


def decide(narrow: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """source, _m_size, source_size, target, repeats, at_hash, take and n (see _cuts; null where nothing is taken once more).

    narrow: a written table with source, _m_size and _m_hash. The totals of sources reach the driver, one row each; the
    counts by length stay on the executors, where a group is a source's distinct lengths.
    """
    spark = narrow.sparkSession
    histogram = write_table(narrow.groupBy("source", "_m_size").agg(F.count(F.lit(1)).alias("n")), "mix-histogram")
    totals = {r.source: r.s for r in histogram.groupBy("source").agg(F.sum(F.col("_m_size") * F.col("n")).alias("s")).collect()}
    goal = targets(totals, weights, most)
    sources = spark.createDataFrame([(s, totals[s], goal[s]) for s in totals], "source string, source_size long, target double")

    def plan(rows: pd.DataFrame) -> pd.DataFrame:
        source = rows["source"].iloc[0]
        repeats, extra = fit_budget(list(zip(rows["_m_size"].tolist(), rows["n"].tolist(), strict=True)), goal[None if pd.isna(source) else source], most)
        return pd.DataFrame({"source": rows["source"], "_m_size": rows["_m_size"], "repeats": repeats, "extra": [extra.get(x, 0) for x in rows["_m_size"]]})

    plans = write_table(histogram.groupBy("source").applyInPandas(plan, "source string, _m_size long, repeats int, extra long"), "mix-plan")
    out = plans.join(_cuts(narrow, plans), _same(plans["source"], plans["_m_size"]), "left").select("source", "_m_size", "repeats", "at_hash", "take", "n")
    out = out.alias("p").join(sources.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source"))).select("p.source", "_m_size", "source_size", "target", "repeats", "at_hash", "take", "n")
    return write_table(out, "mix-decisions")


def _joined(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """rows (from sized) with what is decided for their source and length, under names with the prefix _m_."""
    d = decisions.select(F.col("source").alias("_m_source"), F.col("_m_size").alias("_m_length"), *(F.col(c).alias(f"_m_{c}") for c in ("source_size", "target", "repeats", "at_hash", "take", "n")))
    return rows.join(d, F.col("source").cast("string").eqNullSafe(F.col("_m_source")) & (F.col("_m_size") == F.col("_m_length")))


def _split() -> Column:
    """Whether a row is one of several equal ones of which only some are taken once more."""
    return F.coalesce((F.col("_m_hash") == F.col("_m_at_hash")) & (F.col("_m_take") < F.col("_m_n")), F.lit(False))


def _copies() -> Column:
    return F.col("_m_repeats") + F.coalesce((F.col("_m_hash") <= F.col("_m_at_hash")).cast("int"), F.lit(0))


def _narrow(docs: DataFrame) -> DataFrame:
    return write_table(sized(docs).select("doc_id", F.col("source").cast("string").alias("source"), "_m_size", "_m_hash"), "mix-sizes")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """doc_id, size, source_size, target and taken of each row."""
    narrow = _narrow(docs)
    rows = _joined(narrow, decide(narrow, weights, most))
    told = ["doc_id", F.col("_m_size").alias("size"), F.col("_m_source_size").alias("source_size"), F.col("_m_target").alias("target")]
    whole = rows.filter(~_split()).select(*told, (F.col("_m_size") * _copies()).alias("taken"))
    # equal rows are one count, made into rows again in chunks: the first `take` of them are taken once more
    equal = rows.filter(_split()).groupBy("doc_id", "_m_size", "_m_source_size", "_m_target", "_m_repeats", "_m_source", "_m_hash", "_m_take").agg(F.count(F.lit(1)).alias("_m_n"))
    chunks = equal.withColumn("_m_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m_n") - 1, F.lit(CHUNK_ROWS).cast("long")))).repartition("_m_hash", "_m_from")
    each = chunks.withColumn("_m_i", F.explode(F.sequence(F.col("_m_from"), F.least(F.col("_m_n"), F.col("_m_from") + CHUNK_ROWS) - 1)))
    return whole.unionByName(each.select(*told, (F.col("_m_size") * (F.col("_m_repeats") + (F.col("_m_i") < F.col("_m_take")).cast("int"))).alias("taken")))


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, with the columns of docs."""
    decisions = decide(_narrow(docs), weights, most)
    rows = _joined(sized(docs), decisions)
    copies = F.when(_split(), F.col("_m_repeats")).otherwise(_copies())
    out = rows.filter(copies > 0).withColumn("_m_copy", F.explode(F.sequence(F.lit(1), copies))).select("_row.*")
    if decisions.filter("take < n").isEmpty():
        return out
    # of equal rows one stands for all: as many copies of it as are taken once more
    one = rows.filter(_split()).groupBy("_m_source", "_m_size", "_m_hash", "_m_take").agg(F.first("_row").alias("_m_row"))
    chunks = one.withColumn("_m_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m_take") - 1, F.lit(CHUNK_ROWS).cast("long")))).repartition("_m_hash", "_m_from")
    more = chunks.withColumn("_m_copy", F.explode(F.sequence(F.col("_m_from"), F.least(F.col("_m_take"), F.col("_m_from") + CHUNK_ROWS) - 1)))
    return out.union(more.select("_m_row.*"))
