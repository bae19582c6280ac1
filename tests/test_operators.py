"""Operators on small tables against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import geometry as g
from tidemark.functions import text as x
from tidemark.operators import asof, folds, intervals, rhythm, runs, signal


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_gap_exactly_at_the_limit_stays_together(spark):
    df = spark.createDataFrame([(1, t) for t in (0, 10, 20, 31)], "k int, t int")
    assert rows(runs.segments(df, ["k"], ["t"], "t", 10), "t0", "t1", "n") == [(0, 20, 3), (31, 31, 1)]


def test_adjacent_short_runs_both_flip_and_the_ends_stay(spark):
    flags = [True, False, False, True, False, False, False, False]
    df = spark.createDataFrame([(1, t, f) for t, f in enumerate(flags)], "k int, t int, f boolean")
    got = rows(runs.flip_short_runs(df, ["k"], ["t"], "f", "t", 2), "t", "f")
    # runs: T[0], F[1,2], T[3], F[4..7]; the interior ones last 1 and 0
    assert [f for _, f in got] == [True, True, True, False, False, False, False, False]


def test_run_lengths_give_the_rows_back(spark):
    rng = random.Random(3)
    data = [(k, t, rng.random() < 0.5) for k in range(4) for t in range(50)]
    df = spark.createDataFrame(data, "k int, t int, f boolean")
    again = [(r.k, t, r.f) for r in runs.runs(df, ["k"], ["t"], "f", "t").collect() for t in range(r.t0, r.t1 + 1)]
    assert sorted(again) == sorted(data)


def covered(spans):
    return {i for a, b in spans for i in range(a, b)}


@pytest.mark.parametrize("seed", range(3))
def test_merge_and_subtract_cover_what_they_should(spark, seed):
    rng = random.Random(seed)
    make = lambda n: [(1, a, a + rng.randint(0, 9)) for a in (rng.randint(0, 60) for _ in range(n))]
    outer, inner = make(8), make(5)
    o, i = (spark.createDataFrame(s, "k int, start int, `end` int") for s in (outer, inner))
    merged = rows(intervals.merge(o, ["k"]), "start", "end")
    assert covered(merged) == covered((a, b) for _, a, b in outer)
    assert all(p[1] < q[0] for p, q in zip(merged, merged[1:], strict=False))
    left = rows(intervals.subtract(o, i, ["k"]), "start", "end")
    assert covered(left) == covered((a, b) for _, a, b in outer) - covered((a, b) for _, a, b in inner)


def test_merge_keeps_an_interval_inside_a_longer_one(spark):
    df = spark.createDataFrame([(1, 0, 100), (1, 10, 20), (1, 90, 110), (1, 200, 210)], "k int, start int, `end` int")
    assert rows(intervals.merge(df, ["k"]), "start", "end") == [(0, 110), (200, 210)]


def test_empty_tables_pass_through(spark):
    df = spark.createDataFrame([], "k int, start int, `end` int")
    assert intervals.merge(df, ["k"]).count() == 0
    assert intervals.subtract(df, df, ["k"]).count() == 0
    assert intervals.overlaps(df, df, ["k"], 10).count() == 0


@pytest.mark.parametrize(("forward", "strict"), [(False, False), (False, True), (True, False), (True, True)])
def test_asof_against_a_loop(spark, forward, strict):
    rng = random.Random(5)
    left = [(k, rng.randint(0, 40), i) for i, k in enumerate(rng.choices(range(3), k=40))]
    right = [(k, rng.randint(0, 40), i) for i, k in enumerate(rng.choices(range(3), k=25))]
    got = rows(asof.asof(spark.createDataFrame(left, "k int, t int, i int"), spark.createDataFrame(right, "k int, t int, j int"), ["k"], "t", ["j"], forward, strict), "i", "at")
    want = []
    for k, t, i in left:
        ok = [u for kk, u, _ in right if kk == k and ((u < t or u == t and not strict) if not forward else (u > t or u == t and not strict))]
        want.append((i, (min(ok) if forward else max(ok)) if ok else None))
    assert got == sorted(want)


def test_stays_restart_at_the_row_after(spark):
    df = spark.createDataFrame([(1, float(t), float(p)) for t, p in enumerate([0, 0.05, 0.11, 0.12, 0.5, 0.5])], "k int, t double, x double").withColumn("y", F.lit(0.0))
    assert rows(folds.anchored_stays(df, ["k"], "t", "x", "y", 0.1, 1.0), "t0", "t1", "n") == [(0.0, 1.0, 2), (2.0, 3.0, 2), (4.0, 5.0, 2)]


def test_chains_need_a_clear_lead_below_the_threshold(spark):
    tracks = spark.createDataFrame([(1, t, float(t)) for t in range(1, 6)], "v int, track long, start double")
    pairs = spark.createDataFrame([(1, 1, 2, 0.7), (1, 1, 3, 0.9), (1, 2, 3, 0.55), (1, 3, 4, 0.6), (1, 2, 4, 0.4), (1, 4, 5, 0.61), (1, 2, 5, 0.55)], "v int, a long, b long, score double")
    got = rows(folds.assign_chains(pairs, tracks, ["v"]), "track", "chain")
    # 3: its best, 1, is used, 2 is behind the used one; 4: .6 leads .4; 5: .61 leads .55 by too little
    assert got == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5)]


def test_rhythm_scene(spark):
    stops = [(1, float(s), float(d)) for s, d in ((15, 4), (45, 4), (75, 4), (96, 4), (135, 4), (165, 10), (195, 4))]
    learned = rhythm.learn(spark.createDataFrame(stops, "z int, s double, d double"), ["z"], "s", "d")
    assert {r.s: r.reason for r in learned.collect() if r.reason} == {96.0: "early", 165.0: "long"}
    only = rhythm.summary(learned, ["z"]).first()
    assert abs(only.period - 30) <= 3 and (only.events, only.unexpected) == (7, 2)


def test_interpolation_and_rolling_median_at_the_edges(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, None), (1, 2, 3.0), (1, 3, None)], "k int, t int, v double")
    assert [r[0] for r in df.select("t", signal.interpolate("v", "t", ["k"]).alias("i")).orderBy("t").select("i").collect()] == [1.0, 2.0, 3.0, 3.0]
    up = spark.createDataFrame([(1, t, float(t)) for t in range(5)], "k int, t int, v double")
    assert [r[1] for r in rows(up.select("t", signal.rolling_median("v", ["k"], ["t"]).alias("m")), "t", "m")] == [0.0, 1.0, 2.0, 3.0, 4.0]


def test_polygon_forms_agree(spark):
    points = [(0.1, 0.1), (0.9, 0.2), (0.5, 0.5), (0.7, 0.9), (0.2, 0.8)]
    grid = spark.range(400).select((F.col("id") % 20 / 20 + 0.013).alias("x"), (F.floor(F.col("id") / 20) / 20 + 0.017).alias("y"))
    array = F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in points))
    both = grid.select(g.in_polygon(F.col("x"), F.col("y"), points).alias("a"), g.in_polygon_array(F.col("x"), F.col("y"), array).alias("b"))
    assert both.filter("a <> b").count() == 0 and 0 < both.filter("a").count() < 400


def test_times_and_durations(spark):
    df = spark.createDataFrame([(0.0,), (65.25,), (3725.0,), (-4.0,), (None,)], "s double")
    assert [r[0] for r in df.select(x.format_time(F.col("s"))).collect()] == ["0:00.0", "1:05.3", "1:02:05.0", "0:00.0", "—"]
    asked = spark.createDataFrame([("2.5 minutes",), ("10 s or 3 m",), ("none",)], "q string")
    assert [r[0] for r in asked.select(x.duration_seconds(F.col("q"))).collect()] == [150.0, 10.0, None]


def test_vector_queries_score_all_pairs_and_both_sides(spark):
    from tidemark.plans import catalog

    sf = "/root/testdata/sf0.001"
    of = {}
    for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect():
        of.setdefault(r.label, []).append((r.vec_id, [float(z) for z in r.embedding]))
    shared, near = {}, {}
    dot = lambda u, w: sum(p * q for p, q in zip(u, w, strict=True))
    for vectors in of.values():
        for a, u in vectors:
            others = [(b, w) for b, w in vectors if b != a]
            shared |= {(a, b): sum(min(abs(p), abs(q)) for p, q in zip(u, w, strict=True)) / 2 for b, w in others if a < b}
            near[a] = sorted((-round(dot(u, w) / (dot(u, u) * dot(w, w)) ** 0.5, 9), b) for b, w in others)[:2]
    got = {(r.a, r.b): r.shared for r in catalog.QUERIES["hist_intersection_pairs"](spark, sf).collect()}
    assert got.keys() == shared.keys() and all(got[k] == pytest.approx(shared[k], abs=2e-6) for k in got)
    ranked = catalog.QUERIES["topk_similar_both_sides"](spark, sf).collect()
    assert sorted((r.a, r.b) for r in ranked) == sorted((a, b) for a, bs in near.items() for _, b in bs)


def test_blocks_of_vectors_meet_each_other_once(spark):
    import numpy as np

    from tidemark.operators import similar

    rng = np.random.default_rng(2)
    rows = [(int(i), f"g{i % 2}" if i % 9 else None, v.round(1).tolist()) for i, v in enumerate(rng.standard_normal((90, 3)))] + [(500, "alone", [1.0, 0.0, 0.0]), (501, "g0", None)]
    df = spark.createDataFrame(rows, "i long, g string, v array<double>")
    cos = lambda p, q: float(np.dot(p, q) / np.sqrt(np.dot(p, p) * np.dot(q, q)))
    pairs = {(a[0], b[0]): cos(a[2], b[2]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[2] and b[2]}
    for block in (7, 1_000):
        got = {(r.a, r.b): r.c for r in similar.pairs_above(df, "g", "i", "v", 0.4, block=block).collect()}
        assert got.keys() == {k for k, c in pairs.items() if c > 0.4} and all(got[k] == pytest.approx(pairs[k]) for k in got)
        near = sorted((r.a, r.b) for r in similar.most_similar(df, "g", "i", "v", 3, block=block).collect())
        both = [(a, b, c) for (a, b), c in pairs.items()] + [(b, a, c) for (a, b), c in pairs.items()]
        assert near == sorted((a, b) for a in {x[0] for x in both} for _, b in sorted((-round(c, 9), b) for x, b, c in both if x == a)[:3])


def test_running_median_and_clusters_over_all_hits(spark):
    import statistics

    rng = random.Random(3)
    m, seen = folds.RunningMedian(), []
    for _ in range(200):
        seen.append(rng.random())
        assert m.add(seen[-1]) == pytest.approx(statistics.median(seen))
    boxes = []
    for t in range(60):
        boxes.append((1, t, *(v + rng.random() for v in (0.0, 0.0, 10.0, 10.0))))
        if t % 7 == 0:
            boxes.append((1, t, 100.0, 100.0, 105.0, 105.0))
    df = spark.createDataFrame(boxes, "k int, t int, x1 double, y1 double, x2 double, y2 double")
    got = folds.cluster_boxes(df, ["k"], "t", 0.25, 6, 5, 6).collect()
    (one,) = got  # the other place is seen too seldom to go on
    assert (one.first_t, one.last_t, one.n) == (0, 59, 60) and one.x1 == pytest.approx(statistics.median(b[2] for b in boxes if b[2] < 50))
    hits = df.withColumns({"cls": F.when(F.col("t") < 20, "a").otherwise("b"), "conf": F.lit(0.1)}).filter("x1 < 50").withColumn("t", F.col("t").cast("double"))
    samples = spark.createDataFrame([(1, float(t), t) for t in range(100)], "k int, t double, frame long")
    tracks = folds.static_tracks(hits, samples, ["k"]).collect()
    assert len(tracks) == 60 and {(r.track, r.cls, r.conf) for r in tracks} == {(100_000, "b", 0.45)}


def test_chain_ties_and_verdicts(spark):
    tracks = spark.createDataFrame([(0, t, float(t)) for t in range(5)], "k int, track long, start double")
    pairs = spark.createDataFrame([(0, 0, 3, 0.7), (0, 1, 3, 0.7), (0, 2, 4, 0.55), (0, 1, 4, 0.5)], "k int, a long, b long, score double")
    chains = lambda **told: {r.track: r.chain for r in folds.assign_chains(pairs, tracks, ["k"], **told).collect()}
    assert chains() == {0: 0, 1: 1, 2: 2, 3: 1, 4: 4}  # of equal scores the greatest predecessor
    sure = lambda same, conf: spark.createDataFrame([(0, 2, 4, same, conf)], "k int, a long, b long, same boolean, sure double")
    assert chains(verdicts=sure(True, 0.9))[4] == 2 and chains(verdicts=sure(True, 0.5))[4] == 4 and chains(verdicts=sure(False, 0.9))[4] == 4
    assert chains(verdicts=sure(True, 0.9), most_checks=0)[4] == 4


def test_duplicates_are_asked_in_order_and_by_kind(spark):
    box = lambda i: (0.0 + i, 0.0, 10.0 + i, 10.0)
    rows = [(0, t, float(f), kind, *box(x)) for t, kind, x, n in ((1, "p", 0, 10), (2, "p", 0.5, 10), (3, "q", 0, 10), (4, "p", 0.2, 60)) for f in range(n)]
    hits = spark.createDataFrame([(k, t, f / 5, kind, *b) for k, t, f, kind, *b in rows], "k int, track long, t double, kind string, x1 double, y1 double, x2 double, y2 double")
    assert rows_of(folds.duplicate_tracks(hits, ["k"], "t")) == [(0, 1), (0, 2)]
    assert rows_of(folds.duplicate_tracks(hits.filter("track < 3"), ["k"], "t")) == [(0, 1)]  # the second one has lost its host


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_points_in_spans_against_a_loop(spark):
    rng = random.Random(11)
    spans = [(rng.randint(0, 3), s := rng.randint(0, 200), s + rng.choice([0, 1, 5, 90])) for _ in range(40)]
    points = [(rng.randint(0, 4), rng.randint(0, 300), i) for i in range(300)]
    got = intervals.inside_any(spark.createDataFrame(points, "k int, t int, i int"), spark.createDataFrame(spans, "k int, start int, end int"), ["k"], "t")
    assert got.columns == ["k", "t", "i"] and rows_of(got) == sorted(p for p in points if any(k == p[0] and s <= p[1] <= e for k, s, e in spans))
