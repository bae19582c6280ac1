"""Interval algebra per key: merge, subtract, overlap, containment, coverage. Intervals are closed [start, end]."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from tidemark.operators import products

#: Of overlaps: packs of a part, packs of b that meet one of a where no rank is asked, and rows of equal intervals that go as one.
PACKS, WIDE, SAME = 128, 4, 256


def merge(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", max_gap: float = 0, carry: tuple[str, ...] = ()) -> DataFrame:
    """Unites intervals whose start is at most max_gap after the greatest end so far: keys, start, end, n, and of the columns in
    carry, which are the same for all rows of a key, that value."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = df.withColumn("_open", F.when(F.col(start) - before <= max_gap, 0).otherwise(1))
    island = opened.withColumn("_island", F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in carry)).drop("_island")


def subtract(outer: DataFrame, inner: DataFrame, keys: list[str], start: str = "start", end: str = "end", least: float = 0) -> DataFrame:
    """The pieces of each outer interval that no inner one covers, if at least `least` long: keys, start, end.

    Endpoints become +1/-1 steps; between two endpoints the running sums tell what covers. A single sort per key, no join.
    """
    def steps(df: DataFrame, name: str) -> DataFrame:
        zero = F.lit(0)
        up, down = (F.lit(1), F.lit(-1))
        one = lambda t, d: F.struct(F.col(t).alias("at"), (d if name == "outer" else zero).alias("o"), (d if name == "inner" else zero).alias("i"))
        return df.select(*keys, F.explode(F.array(one(start, up), one(end, down))).alias("s")).select(*keys, "s.at", "s.o", "s.i")

    marks = steps(outer, "outer").unionByName(steps(inner, "inner")).groupBy(*keys, "at").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    w = Window.partitionBy(*keys).orderBy("at")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    spans = marks.select(*keys, F.col("at").alias(start), F.lead("at").over(w).alias(end), F.sum("o").over(upto).alias("o"), F.sum("i").over(upto).alias("i"))
    free = spans.filter((F.col("o") > 0) & (F.col("i") == 0) & (F.col(end) > F.col(start)))
    return merge(free, keys, start, end).drop("n").filter(F.col(end) - F.col(start) >= least)


def _levels(df: DataFrame, bucket: int, start: str, end: str) -> DataFrame:
    """df with _level: the least l for which buckets of bucket * 2^l are at least as long as the interval, so it meets two at most."""
    span = F.floor(F.col(end) / bucket).cast("long") - F.floor(F.col(start) / bucket).cast("long")
    return df.withColumn("_level", F.when(span <= 1, 0).otherwise(F.ceil(F.log2(span.cast("double")))).cast("int"))


def _comparable(columns: list[pa.Array]) -> list[np.ndarray]:
    """The columns as arrays that compare as they do; decimals by their places in the order of all."""
    arrays = [c.to_numpy(zero_copy_only=False) for c in columns]
    if all(x.dtype != object for x in arrays):
        return arrays
    places = np.unique(np.concatenate(arrays), return_inverse=True)[1]
    return np.split(places, np.cumsum([len(x) for x in arrays])[:-1])


def _spans(start: np.ndarray, end: np.ndarray, first: np.ndarray, home: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """An order of rows, and what lies in it: equal intervals, SAME rows of one at most, by the least rank of their rows."""
    rows = np.lexsort((rank, end, start))
    s, e, r, places = start[rows], end[rows], rank[rows], np.arange(len(rows))
    new = np.r_[True, (s[1:] != s[:-1]) | (e[1:] != e[:-1])]
    at = np.flatnonzero(new | ((places - np.maximum.accumulate(np.where(new, places, 0))) % SAME == 0))
    n = np.diff(at, append=len(rows))
    spans = {"at": at, "n": n, "start": s[at], "end": e[at], "first": first[rows][at], "home": home[rows][at], "least": r[at], "most": r[at + n - 1]}
    return rows, _at(spans, np.argsort(r[at], kind="stable"))


def _at(spans: dict[str, np.ndarray], i: np.ndarray | slice) -> dict[str, np.ndarray]:
    return {c: v[i] for c, v in spans.items()}


def _met(a: dict[str, np.ndarray], b: dict[str, np.ndarray], node: int, pack: int, once: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the rows of the spans that meet in this bucket. Four kinds, by which begins and which ends first, so that one
    kind's pairs share all of one; of a kind, the next span of a meets nearly what the one before it met, up to some place."""
    for i in range(0, len(a["at"]), pack):
        x = _at(a, slice(i, i + pack))
        above = np.searchsorted(b["least"], x["most"].max(), "right") if once else 0
        cuts = [*range(0, above, pack), *range(above, len(b["at"]), WIDE * pack), len(b["at"])]
        for j, k in zip(cuts[:-1], cuts[1:], strict=True):
            y = _at(b, slice(j, k))
            if once and x["least"].min() >= y["most"].max():
                continue
            by = [{c: _at(side, np.argsort(side[c], kind="stable")) for c in ("start", "end")} for side in (x, y)]
            for early, late, c, d in ((False, False, "start", "end"), (True, True, "start", "end"), (True, False, "end", "start"), (False, True, "start", "end")):
                u, v = by[0][c], by[1][d]
                s, e, f, least = (u[c][:, None] for c in ("start", "end", "first", "least"))
                meet = (s <= v["end"]) & (v["start"] <= e) & ((s < v["start"]) == early) & ((e > v["end"]) == late) & (np.maximum(f, v["first"]) == node)
                p, q = np.nonzero(meet & (least < v["most"]) if once else meet)
                for k, of_a, of_b in products.of(u["n"][p], v["n"][q]):
                    yield u["at"][p[k]] + of_a, v["at"][q[k]] + of_b


def overlaps(a: DataFrame, b: DataFrame, keys: list[str], bucket: int, start: str = "start", end: str = "end", pack: int = 256, once: str | None = None) -> DataFrame:
    """Pairs with a common instant: keys, a's and b's columns with the prefixes a_ and b_. once: a column of numbers; only pairs
    with less of it in a than in b.

    Buckets of bucket, 2 * bucket, 4 * bucket, ... An interval of any length lies at home in one or two buckets of the level
    of its own length, and visits one or two at each higher level that some interval is at home in. A pair meets where the
    longer one is at home, in the first bucket that both touch: equal keys, each pair once, and no row for each bucket of a
    long interval. The levels that occur, 64 numbers at most, are a scalar of the same plan, so what a and b are made from is
    shuffled once for both.

    A bucket's rows are dealt into parts of PACKS * pack, and each two parts meet in one task, pack by pack, however many rows
    a bucket has. Few rows make many pairs, so the tasks are as many as the session's shuffle partitions. Pairs come in an
    order that a file holds in few bytes: a row of a with row after row of b, the next one with nearly the same rows again;
    those with one in the other apart, so that the common time is one's whole length; equal intervals together.
    """
    known = [df.filter(reduce(and_, (F.col(c).isNotNull() for c in (*keys, start, end, *([once] if once else []))))) for df in (a, b)]
    levels = [_levels(df, bucket, start, end) for df in known]
    found = [df.agg(F.collect_set("_level")).scalar() for df in levels]
    tasks = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = [[c for c in df.columns if c not in keys] for df in (a, b)]
    rows = [F.struct(*names) for names in rest]
    kinds = [df.select(row).schema[0].dataType for df, row in zip((a, b), rows, strict=True)]
    node = lambda c: F.floor(F.floor(F.col(c) / bucket) / F.pow(F.lit(2.0), F.col("_at"))).cast("long")
    on = [*keys, "_level", "_node"]

    def side(k: int) -> DataFrame:
        """a's (0) or b's (1) rows once for each bucket that they are at home in or visit."""
        at = levels[k].withColumn("_found", found[1 - k]).withColumn("_at", F.explode(F.concat(F.array("_level"), F.filter("_found", lambda x: x > F.col("_level")))))
        held = [(row if i == k else F.lit(None).cast(kind)).alias(f"_{i}") for i, (row, kind) in enumerate(zip(rows, kinds, strict=True))]
        placed = at.select(*keys, F.lit(k).alias("_side"), (F.col("_at") == F.col("_level")).alias("_home"), F.col("_at").alias("_level"), node(start).alias("_first"), node(end).alias("_last"), *held)
        return placed.withColumn("_node", F.explode(F.sequence("_first", "_last"))).drop("_last")

    order = [f"_{k}.{c}" for k in (0, 1) for c in (*([once] if once else []), start, end, *(c for c, kind in (a, b)[k].dtypes if c in rest[k] and "map<" not in kind and "variant" not in kind))]
    place = F.row_number().over(Window.partitionBy(*on, "_side").orderBy(*order)) - 1
    placed = side(0).unionByName(side(1)).repartition(tasks, *on).withColumn("_part", F.floor(place / F.lit(PACKS * pack)).cast("int"))
    last = [F.max(F.when(F.col("_side") == k, F.col("_part"))).over(Window.partitionBy(*on)) for k in (0, 1)]
    mine = F.col("_side") == 0
    dealt = placed.withColumn("_last", F.when(mine, last[1]).otherwise(last[0])).withColumn("_other", F.explode(F.sequence(F.lit(0), "_last")))
    sent = dealt.select(*on, F.when(mine, F.col("_part")).otherwise(F.col("_other")).alias("_pa"), F.when(mine, F.col("_other")).otherwise(F.col("_part")).alias("_pb"), "_side", "_home", "_first", "_0", "_1")
    names = [*keys, *(p + c for p, of in zip(("a_", "b_"), rest, strict=True) for c in of)]
    schema = StructType([*(StructField(k, a.schema[k].dataType) for k in keys), *(StructField(p + c, df.schema[c].dataType) for p, df, of in zip(("a_", "b_"), (a, b), rest, strict=True) for c in of)])

    def pairs(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(batches).combine_chunks()
        sides, home, first = (group.column(c).to_numpy() for c in ("_side", "_home", "_first"))
        mines, own_rows, held, ranks, spans = [], [], [], [], []
        for k in (0, 1):
            mine = np.flatnonzero(sides == k)
            row = group.column(f"_{k}").combine_chunks().take(pa.array(mine))
            mines.append(mine)
            own_rows.append(row)
        times = _comparable([row.field(c) for row in own_rows for c in (start, end)])
        asked = _comparable([row.field(once) for row in own_rows]) if once else [np.zeros(len(mine)) for mine in mines]
        for row, mine, s, e, rank in zip(own_rows, mines, times[::2], times[1::2], asked, strict=True):
            rows, own = _spans(s, e, first[mine], home[mine], rank)
            held.append(row.take(pa.array(rows)).flatten())
            ranks.append(rank[rows])
            spans.append(own)
        node = key[len(keys) + 1].as_py()
        for own, other in ((spans[0]["home"], spans[1]["home"] | True), (~spans[0]["home"], spans[1]["home"])):
            for i, j in _met(_at(spans[0], own), _at(spans[1], other), node, pack, once is not None):
                if once:
                    i, j = (x[ranks[0][i] < ranks[1][j]] for x in (i, j))
                columns = [c.take(pa.array(x)) for of, x in zip(held, (i, j), strict=True) for c in of]
                yield pa.RecordBatch.from_arrays([*(pa.repeat(k, len(i)) for k in key[: len(keys)]), *columns], names)

    groups = [*on, "_pa", "_pb"]
    return sent.repartition(tasks, *groups).groupBy(*groups).applyInArrow(pairs, schema)


def inside_any(points: DataFrame, spans: DataFrame, keys: list[str], time: str, start: str = "start", end: str = "end") -> DataFrame:
    """points whose time lies in some span of their key, ends included.

    A point lies in a span if the greatest end among spans that began by then is not before it: a union and one window per
    key, without a join.
    """
    ends = spans.select(*keys, F.col(start).alias("_t"), F.lit(0).alias("_point"), F.col(end).alias("_end"), F.lit(None).cast(points.select(F.struct(*points.columns)).schema[0].dataType).alias("_row"))
    asks = points.select(*keys, F.col(time).alias("_t"), F.lit(1).alias("_point"), F.lit(None).cast(ends.schema["_end"].dataType).alias("_end"), F.struct(*points.columns).alias("_row"))
    w = Window.partitionBy(*keys).orderBy("_t", "_point").rowsBetween(Window.unboundedPreceding, 0)
    return ends.unionByName(asks).withColumn("_upto", F.max("_end").over(w)).filter("_point = 1 AND _upto >= _t").select("_row.*")


def gaps(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """The time between the greatest end so far and the next start: keys, start, end."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.select(*keys, before.alias("_from"), F.col(start).alias("_to")).filter("_from < _to").select(*keys, F.col("_from").alias(start), F.col("_to").alias(end))


def coverage(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """keys, covered (length of the union) and n."""
    return merge(df, keys, start, end).groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).alias("covered"), F.sum("n").alias("n"))
