"""Keys of content, partial renewal, grids of key points, overlaps of any length."""

import hashlib
import json
import random
from pathlib import Path

from pyspark.sql import functions as F

from tidemark.operators import intervals, resample
from tidemark.plans.eventlog import Zone
from tidemark.sources import cache


def test_content_keys(spark, tmp_path):
    for name, content in (("a", b"x" * 100), ("b", b"x" * 99), ("c", b"x" * 100), ("d", b"x" * 40 + b"y" * 60)):
        (tmp_path / name).write_bytes(content)
    files = spark.createDataFrame([(str(tmp_path / n),) for n in "abcd"], "path string")
    key = lambda settings, zones=(), **more: {Path(r.path).name: r.key for r in cache.content_keys(files, settings, zones, **more).collect()}
    area, activity = Zone("A", ((0.1, 0.2), (0.3, 0.4), (0.5, 0.1))), Zone("M", ((0.1, 0.2), (0.3, 0.4), (0.5, 0.1)), "activity")
    base = key({"conf": 1, "stay_min": 8})
    assert base["a"] == base["c"] and len(set(base.values())) == 3
    assert base == key({"conf": 1.0, "stay_min": 9}) == key({"conf": 1}, (area,))
    assert base != key({"conf": 0.5}) and base != key({"conf": 1}, (activity,)) and base != key({"conf": 1}, version=2)
    assert key({}, head=40)["a"] == key({}, head=40)["d"] != key({}, head=40)["b"]
    told = json.dumps({"settings": {"conf": 1.0}, "activity": [], "version": 1}, sort_keys=True)
    assert base["a"] == hashlib.sha256(b"x" * 100 + b"100" + told.encode()).hexdigest()[:16]


def test_only_changed_keys_are_made_again(spark, tmp_path):
    path, asked = str(tmp_path / "t"), []

    def make(rows):
        asked.append(sorted({r.v for r in rows.select("v").distinct().collect()}))
        return rows.filter("x > 0").groupBy("v").agg(F.sum("x").alias("total"))

    run = lambda rows, settings="": [sorted(map(tuple, df.collect())) for df in cache.refresh(path, spark.createDataFrame(rows, "v string, x long"), "v", make, settings)]
    stamp = lambda v: {f.name for f in Path(path, f"v={v}").glob("*.parquet")}
    rows = [("a", 1), ("a", 2), ("b", 5), ("c", 7)]
    assert run(rows) == [[("a", 3), ("b", 5), ("c", 7)], [("a",), ("b",), ("c",)]]
    files = {v: stamp(v) for v in "abc"}
    assert run(rows[::-1]) == [[("a", 3), ("b", 5), ("c", 7)], []]
    assert run([("a", 1), ("a", 2), ("b", 6), ("c", 7)]) == [[("a", 3), ("b", 6), ("c", 7)], [("b",)]]
    assert stamp("a") == files["a"] and stamp("c") == files["c"] and stamp("b") != files["b"]
    assert run([("a", -1), ("b", 6), ("b", 6)]) == [[("b", 12)], [("a",), ("b",)]]  # a has no result, c is gone
    assert run([("a", 1), ("a", 2), ("c", 7)])[0] == [("a", 3), ("c", 7)]
    assert run([("a", 1), ("a", 2), ("c", 7)], "other settings")[1] == [("a",), ("c",)]
    assert run([])[0] == [] and asked[0] == ["a", "b", "c"] and asked[1] == [] and asked[2] == ["b"]


def test_grid_of_key_points(spark):
    rng = random.Random(3)
    points = [(k, rng.randint(-500, 2_000), rng.random(), rng.random()) for k in range(6) for _ in range(rng.choice([1, 2, 9]))]
    df = spark.createDataFrame(points + points[:3], "k int, t long, x double, y double")
    got = {(r.k, r.t): (r.x, r.y) for r in resample.on_grid(df, ["k"], "t", ["x", "y"], 70).collect()}
    want = {}
    for k in range(6):
        mine = sorted((p[1], p[2:]) for p in points if p[0] == k)
        for t in range(-1_000, 3_000):
            if t % 70 or not mine[0][0] <= t <= mine[-1][0]:
                continue
            (t0, a), (t1, b) = max(m for m in mine if m[0] <= t), min((m for m in mine if m[0] >= t), default=mine[-1])
            u = 0 if t1 == t0 else (t - t0) / (t1 - t0)
            want[k, t] = tuple(p + (q - p) * u for p, q in zip(a, b, strict=True))
    assert got.keys() == want.keys() and all(abs(p - q) < 1e-9 for key in want for p, q in zip(got[key], want[key], strict=True))
    flags = resample.changes(spark.createDataFrame([(1, 0, None), (1, 1, True), (1, 2, True), (1, 3, False), (2, 0, True)], "k int, t int, f boolean"), ["k"], "t", F.col("f"))
    assert sorted(map(tuple, flags.collect())) == [(1, 1, True), (1, 3, False), (2, 0, True)]


def test_overlaps_of_any_length(spark):
    rng = random.Random(9)
    make = lambda n: [(rng.randint(0, 2), s := rng.randint(-3_000, 3_000), s + rng.choice([0, 1, 7, 20, 300, 4_000, 10_000_000]), i) for i in range(n)]
    a, b = make(150), make(170)
    df = lambda rows: spark.createDataFrame(rows, "k int, start long, end long, i int")
    got = intervals.overlaps(df(a), df(b), ["k"], 10).select("a_i", "b_i").collect()
    want = sorted((x[3], y[3]) for x in a for y in b if x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2])
    assert sorted(map(tuple, got)) == want
    one = spark.createDataFrame([(0, 0, 10 * 1_000_000, 1)], "k int, start long, end long, i int")
    plan = intervals.overlaps(one, one, ["k"], 10)
    assert plan.count() == 1 and plan.first().a_i == 1
