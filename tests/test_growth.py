"""What must not grow faster than the input: plans without broadcasts of samples, quadratic frames or joins, and steps held
against plain loops."""

import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import noisy
from tidemark.operators import asof, folds, intervals, runs, similar
from tidemark.plans import catalog, identity
from tidemark.sources import tables

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["log_visibility", "log_zones", "log_interactions"])
def test_samples_are_dealt_once(spark, name):
    """Events are shuffled by video, their samples never."""
    told = plan(catalog.QUERIES[name](spark, SF))
    assert told.count("Exchange") == 1 and "Exchange hashpartitioning(video_id" in told


@pytest.mark.parametrize("name", ["log_left_objects", "log_interactions", "log_stays"])
def test_no_samples_to_the_driver(spark, name):
    """no side of a join of samples is broadcast."""
    assert "BroadcastExchange" not in plan(catalog.QUERIES[name](spark, SF))


def test_clamped_asof_runs_through_a_key_once(spark):
    """no frame that ends at the last row and begins anew at each."""
    left, right = (spark.createDataFrame([(1, t) for t in ts], "k int, t int") for ts in ((0, 5, 9), (3, 7)))
    for forward, want in ((True, [3, 7, 7]), (False, [3, 3, 7])):
        found = asof.asof(left, right.withColumn("v", F.col("t")), ["k"], "t", ["v"], forward=forward, clamp=True)
        assert [r.found_v for r in found.orderBy("t").collect()] == want
        assert "currentrow$(), unboundedfollowing$()" not in plan(found)


def test_samples_are_fitted_by_all_cores(spark):
    """a table in one file is dealt out before it is fitted."""
    assert "RoundRobinPartitioning" in plan(catalog.QUERIES["registered_samples"](spark, SF))


def test_a_mean_at_the_limit_is_not_weak(spark):
    """whatever the order in which a mean was summed."""
    rows = spark.createDataFrame([(1, 0.4), (2, 0.39999999999999997), (3, 0.3999)], "track int, conf double").selectExpr("*", "0D AS start", "2D AS end", "5 AS n")
    assert sorted(r.track for r in identity.keep_solid(rows).collect()) == [1, 2]


def test_live_rows_without_pairs(spark):
    """no join of asked times with all rows of their bucket."""
    assert "Join" not in plan(catalog.QUERIES["live_at"](spark, SF))


def test_medians_ahead():
    rng = np.random.default_rng(5)
    values, ends = rng.integers(0, 50, 40).astype(float), np.repeat([7, 8, 30, 40], [7, 1, 22, 10])
    assert folds.medians_ahead(values, ends, 11).tolist() == [float(np.median(values[i : min(e, i + 11)])) for i, e in enumerate(ends)]


def test_short_spans_as_short_runs(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(int(k), t, bool(f)) for k in range(4) for t, f in enumerate(rng.random(60) < 0.5)], "k int, t int, f boolean")
    want = runs.runs(runs.flip_short_runs(rows, ["k"], ["t"], "f", "t", 2, 0.5), ["k"], ["t"], "f", "t")
    spans = runs.flip_short_spans(runs.runs(rows, ["k"], ["t"], "f", "t"), ["k"], "t0", "t1", "f", 2, 0.5)
    got = runs.with_run(spans.drop("run"), ["k"], ["t0"], "f").groupBy("k", "run").agg(F.first("f").alias("f"), F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.sum("n").alias("n"))
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def chained(tracks, reach):
    """link_chains' rule told by its SQL, pair by pair: names and predecessors in the order of (start, track)."""
    order, used, before = sorted(tracks, key=lambda t: (t[1], t[0])), set(), {}
    for q, (name, start, _) in enumerate(order):
        told = sorted(((1 - (start - e) / reach, a) for a, _, e in order[:q] if start - reach <= e <= start), reverse=True)
        may = [(s, a) for r, (s, a) in enumerate(told) if s >= 0.62 or (r == 0 and s >= 0.5 and len(told) > 1 and s - told[1][0] >= 0.12)]
        got = next(((s, a) for s, a in may if a not in used), None)
        if got:
            used.add(got[1])
            before[name] = got
    return before


def test_chains_by_gap_are_those_of_all_pairs(spark):
    """with many tracks of one start, one end and one instant, and none of the pairs written down."""
    rng = np.random.default_rng(11)
    tracks = [(k, int(name), int(s), int(s + rng.choice([0, 0, 1, 3, 8]))) for k in range(12) for name, s in zip(rng.permutation(40), rng.integers(0, 150 if k % 2 else 25, 40), strict=True)]
    found = folds.chain_by_gap(spark.createDataFrame(tracks, "k int, track long, start long, end long"), ["k"], 20)
    got, links = {(r.k, r.track): (r.chain, r.score) for r in found.collect()}, 0
    for k in range(12):
        before = chained([t[1:] for t in tracks if t[0] == k], 20)
        for _, name, *_ in (t for t in tracks if t[0] == k):
            head = name
            while head in before:
                head = before[head][1]
            assert got[k, name] == (head, before[name][0] if name in before else None)
        links += len(before)
    assert links > 100
    assert "Join" not in plan(catalog.QUERIES["link_chains"](spark, SF))


def shuffled_rows(spark):
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_vectors_are_sent_to_few_blocks(spark):
    """however many vectors a group has."""
    rng = np.random.default_rng(2)
    vectors = rng.random((90, 4)).astype(np.float32)
    df = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(vectors)], "g int, i int, v array<float>")
    before = shuffled_rows(spark)
    got = {(r.a, r.b): r.c for r in similar.pairs_above(df, "g", "i", "v", -1.0, similar.overlap, block=2).collect()}
    assert shuffled_rows(spark) - before < 90 * (similar.BLOCKS + 3)
    want = {(a, b): float(np.minimum(vectors[a].astype(float), vectors[b].astype(float)).sum() / 2) for a in range(90) for b in range(a + 1, 90)}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in want)


def test_tiles_of_a_block(spark):
    """blocks of more rows than a tile, with themselves and with others."""
    rng = np.random.default_rng(4)
    vectors = rng.random((700, 3))
    df = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(vectors)], "g int, i int, v array<double>")
    scores = similar.cosine(vectors, vectors)
    for block in (400, 1000):
        assert {(r.a, r.b) for r in similar.pairs_above(df, "g", "i", "v", 0.99, block=block).collect()} == {(a, b) for a, b in zip(*map(np.ndarray.tolist, np.nonzero(np.triu(scores > 0.99, 1))), strict=True)}
        best = {(r.a, r.b) for r in similar.most_similar(df, "g", "i", "v", 2, block=block).collect()}
        np.fill_diagonal(scores, -1)
        assert best == {(a, int(b)) for a in range(700) for b in sorted(range(700), key=lambda j: (-round(scores[a, j], 9), j))[:2]}  # noqa: B023
        scores = similar.cosine(vectors, vectors)


def test_configs_have_no_file_each(spark):
    """the config of all subjects is a few files of lines."""
    catalog.QUERIES["sinks_read_back"](spark, SF).collect()
    assert not list(Path(tables.shared_folder(spark)).glob("tidemark/*/config-*/gid=*"))


def test_pieces_are_cut_once(spark):
    """A text of many quotes is cut once, not once a piece."""
    text = '"a" ' * 20_000 + '[1 {"x": [1]} {"y": 2}'
    began = time.monotonic()
    assert spark.range(1).select(noisy.first_json(F.lit(text))).first()[0] == '{"x": [1]}'
    assert time.monotonic() - began < 20


def test_hits_are_compared_where_they_lie(spark):
    """hits that are dealt by video are shuffled by no later step, also where nothing is broadcast; same tracks by a loop."""
    rng = np.random.default_rng(8)
    boxes = {(v, track): (rng.integers(0, 20, 2).tolist(), rng.integers(10, 30, 2).tolist()) for v in range(4) for track in (1, 2, 3, 4, 100_000, 100_001)}
    classes = {1: "person", 2: "person", 3: "car", 4: "person", 100_000: "suitcase", 100_001: "person"}
    rows = [(v, t / 2, track, classes[track], 0.41 + 0.01 * (track % 7), float(x), float(y), float(x + w), float(y + h)) for (v, track), ((x, y), (w, h)) in boxes.items() for t in range(8 if track == 1 else 300)]
    hits = spark.createDataFrame(rows, "v int, t double, track long, cls string, conf double, x1 double, y1 double, x2 double, y2 double").repartition(2, "v")
    known, before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), shuffled_rows(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = sum(min(len(r) for r in (a, b)) for v in range(4) for a in ([r for r in rows if r[0] == v and r[2] == i] for i in classes) for b in ([r for r in rows if r[0] == v and r[2] == j] for j in classes) if a[0][2] != b[0][2])
        solid = {(r.v, r.track) for r in identity.solid_hits(hits, ["v"])[0].collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", known)
    share = lambda v, a, b: np.prod([max(0, min(boxes[v, a][0][i] + boxes[v, a][1][i], boxes[v, b][0][i] + boxes[v, b][1][i]) - max(boxes[v, a][0][i], boxes[v, b][0][i])) for i in (0, 1)]) / np.prod(boxes[v, a][1])
    want = set()
    for v in range(4):
        left = {k for k in classes if k != 1 or not any(share(v, 1, o) > 0.6 for o in (2, 4, 100_001))}
        weak = {k for k in left if k >= 100_000 or (classes[k] == "person" and 0.41 + 0.01 * (k % 7) < 0.45)}
        seen = lambda k, o: 8 if 1 in (k, o) else 300
        hides = lambda k, o: (classes[k] == "person" and classes[o] == "car" and share(v, k, o) > 0.8) or (k >= 100_000 and classes[o] == "person" and share(v, k, o) > 0.5)  # noqa: B023, E731
        for k in left:
            most = max((seen(k, o) for o in left if o != k and k in weak and hides(k, o)), default=0)
            if not most or most < (0.5 if k >= 100_000 else 0.6) * (8 if k == 1 else 300):
                want.add((v, k))
    assert solid == want and len(want) < len(boxes)
    assert 0 < shuffled_rows(spark) - before < len(rows) + pairs


def test_nested_boxes_against_a_loop(spark):
    """who lies in whom, at the same instant alone."""
    rng = np.random.default_rng(6)
    rows = [(int(k), float(t), track, *map(float, (x, y, x + w, y + h))) for k in range(2) for t in range(6) for track, (x, y, w, h) in enumerate(rng.integers(1, 12, (5, 4)).tolist())]
    got = {(r.k, r.t, r.track, r.other): r.share for r in folds.nested(spark.createDataFrame(rows, "k int, t double, track long, x1 double, y1 double, x2 double, y2 double"), ["k"], "t", 0.5).collect()}
    want = {}
    for k, t, a, *p in rows:
        for l, u, b, *q in rows:
            shared = max(0, min(p[2], q[2]) - max(p[0], q[0])) * max(0, min(p[3], q[3]) - max(p[1], q[1])) / ((p[2] - p[0]) * (p[3] - p[1]))
            if (k, t) == (l, u) and a != b and shared > 0.5:
                want[k, t, a, b] = shared
    assert got == want and want


def test_boxes_are_clustered_on_arrow_columns(spark):
    """no pandas frame a key; the same clusters as a plain loop's, also past sixteen of them."""
    rng = np.random.default_rng(9)
    rows = [(k, int(t), *map(float, (x, y, x + w, y + h))) for k in range(3) for t, (x, y, w, h) in zip(rng.integers(0, 400, 150), zip(*rng.integers(0, 30, (2, 150)), *rng.integers(3, 20, (2, 150)), strict=True), strict=True)]
    found = folds.cluster_boxes(spark.createDataFrame(rows, "k int, us long, x1 double, y1 double, x2 double, y2 double"), ["k"], "us", 0.25, 60, 20, 2)
    want, most = [], 0
    for k in range(3):
        clusters = []
        for _, t, *b in sorted(r for r in rows if r[0] == k):
            shares = []
            for c in clusters:
                m = [float(np.median(side)) for side in zip(*c["boxes"], strict=True)]
                w, h = (max(0, min(b[i + 2], m[i + 2]) - max(b[i], m[i])) for i in (0, 1))
                shares.append(w * h / ((m[2] - m[0]) * (m[3] - m[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h + 1e-9))
            best = max(range(len(shares)), key=lambda i: (shares[i], -i), default=None)
            if best is None or not shares[best] > 0.25 or t - clusters[best]["last"] > 60:
                clusters.append({"first": t, "last": t, "boxes": [b]})
            else:
                clusters[best]["boxes"].append(b)
                clusters[best]["last"] = t
        most = max(most, len(clusters))
        lasting = [c for c in clusters if c["last"] - c["first"] >= 20 and len(c["boxes"]) >= 2]
        want += [(k, i, c["first"], c["last"], len(c["boxes"]), *(float(np.median(side)) for side in zip(*c["boxes"], strict=True))) for i, c in enumerate(lasting)]
    assert sorted(map(tuple, found.collect())) == sorted(want) and most > 16 and want
    assert "FlatMapGroupsInArrow" in plan(found)


def test_equal_intervals_overlap_as_one(spark, tmp_path):
    """rows of one interval cross the join together, more than a pack of them too, and their pairs are stored as runs; no
    job is run to plan it."""
    spans = [(s * 7 % 90, s * 7 % 90 + s % 40) for s in range(30)]
    rows = [(k, *spans[i % 30], i) for k in (0, 1) for i in range(900)] + [(None, 0, 9, -1), (0, None, 9, -2), (0, 0, None, -3)]
    df = spark.createDataFrame(rows, "k int, start long, end long, i long")
    spark.sparkContext.setJobGroup("planning", "overlaps")
    found = intervals.overlaps(df, df, ["k"], 10)
    planned = spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not planned and found.columns == ["k", "a_start", "a_end", "a_i", "b_start", "b_end", "b_i"]
    found.write.parquet(str(tmp_path / "pairs"))
    meet = sum(s <= v and u <= t for s, t in spans for u, v in spans)
    pairs = spark.read.parquet(str(tmp_path / "pairs"))
    assert pairs.count() == 2 * 30 * 30 * meet
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.4 * pairs.count()
    few = df.filter("i % 30 < 5 AND i < 300 OR i < 0")
    known = [r for r in rows if None not in r[:3] and r[3] % 30 < 5 and r[3] < 300]
    want = sorted((x[0], x[3], y[3]) for x in known for y in known if x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2])
    assert sorted(map(tuple, intervals.overlaps(few, few, ["k"], 10, pack=3).select("k", "a_i", "b_i").collect())) == want
    bare = few.filter("i >= 0").select("k", "start", "end")
    assert intervals.overlaps(bare, few, ["k"], 10, pack=3).count() == len(want)


def test_a_bucket_of_intervals_is_dealt_out(spark):
    """the pairs of one bucket are many tasks' work, and only those asked for are made."""
    rng = np.random.default_rng(8)
    rows = [(1, int(s), int(s + d), i, i % 50) for i, (s, d) in enumerate(zip(rng.integers(0, 900, 1_200), rng.integers(0, 90, 1_200), strict=True))] + [(1, 5, 9, -1, None)]
    df = spark.createDataFrame(rows, "k int, start long, end long, i int, of int")
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        found = intervals.overlaps(df, df, ["k"], 1_000, pack=3)
        at = {r[0] for r in found.groupBy(F.spark_partition_id()).count().collect()}
        once = intervals.overlaps(df, df, ["k"], 1_000, pack=3, once="of").select("a_i", "b_i").collect()
        pairs = found.select("a_i", "b_i").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    assert len(at) > 2
    exact = df.filter("i < 40").selectExpr("k", "cast(start + 0.25 AS decimal(20, 2)) AS start", "cast(end + 0.25 AS decimal(20, 2)) AS end", "i")
    few = [r for r in rows if r[3] < 40]
    assert sorted(map(tuple, intervals.overlaps(exact, exact, ["k"], 10).select("a_i", "b_i").collect())) == sorted((x[3], y[3]) for x in few for y in few if x[1] <= y[2] and y[1] <= x[2])
    meet = [(x, y) for x in rows for y in rows if x[1] <= y[2] and y[1] <= x[2]]
    assert sorted(map(tuple, pairs)) == sorted((x[3], y[3]) for x, y in meet)
    assert sorted(map(tuple, once)) == sorted((x[3], y[3]) for x, y in meet if None not in (x[4], y[4]) and x[4] < y[4])


def test_pairs_of_different_intervals_lie_in_few_bytes(spark, tmp_path):
    """where no two intervals are equal, what a file holds is little more than the common times of those that only touch."""
    rng = np.random.default_rng(6)
    rows = [(int(s), int(s + d), i) for i, (s, d) in enumerate(zip(rng.integers(0, 10**12, 3_000), rng.integers(0, 10**12, 3_000), strict=True))]
    df = spark.createDataFrame(rows, "start long, end long, i long").withColumn("k", F.lit(1)).repartition(4)
    found = intervals.overlaps(df, df, ["k"], 10**11).select("a_i", "a_start", "b_i", "b_start")
    found.write.parquet(str(tmp_path / "pairs"))
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.9 * spark.read.parquet(str(tmp_path / "pairs")).count()


def test_equal_vectors_go_as_one(spark, tmp_path, monkeypatch):
    """Sent and scored once, their pairs stored as runs; a vector of many names in pieces."""
    rng = np.random.default_rng(9)
    vectors = rng.random((150, 4)).astype(np.float32)
    df = spark.createDataFrame([(1, int(c * 1_000 + i), v.tolist()) for c in range(8) for i, v in enumerate(vectors)], "g int, i long, v array<float>").repartition(4)
    before = shuffled_rows(spark)
    similar.pairs_above(df, "g", "i", "v", -1.0, similar.overlap, block=100).write.parquet(str(tmp_path / "pairs"))
    assert shuffled_rows(spark) - before < 150 * (similar.BLOCKS + 2) + 3 * 1_200
    pairs = spark.read.parquet(str(tmp_path / "pairs"))
    assert pairs.count() == 1_200 * 1_199 // 2 == pairs.filter("a < b").distinct().count()
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 1.2 * pairs.count()
    monkeypatch.setattr(similar, "SAME", 3)
    few = [(c * 1_000 + i, vectors[i].astype(float)) for i in range(12) for c in range(1 + 7 * (i < 3))]
    some = spark.createDataFrame([(1, int(i), v.tolist()) for i, v in few], "g int, i long, v array<double>")
    scores = {(a, b): float(similar.cosine(v[None], w[None])[0, 0]) for a, v in few for b, w in few if a != b}
    got = [(r.a, r.b) for r in similar.pairs_above(some, "g", "i", "v", 0.9, block=7).collect()]
    assert sorted(got) == sorted(p for p, c in scores.items() if p[0] < p[1] and c > 0.9) and got
    near = sorted((r.a, r.b) for r in similar.most_similar(some, "g", "i", "v", 3, block=7).collect())
    assert near == sorted((a, b) for a, _ in few for b in sorted((b for b, _ in few if b != a), key=lambda b: (-round(scores[a, b], 9), b))[:3])  # noqa: B023
