"""The same sessions from a stream and from a batch."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import folds
from tidemark.streaming import online
from tidemark.streaming.sessions import hourly_counts, sessions

SF = "/root/testdata/sf0.001"
DATA = f"{SF}/events.parquet"


def test_sessions_as_stream(spark, tmp_path):
    batch = spark.read.parquet(DATA)
    batch.write.parquet(str(tmp_path / "in"))
    stream = sessions(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")), "user_id", "ts", "24 hours")
    q = stream.writeStream.format("memory").queryName("sess").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = sorted(map(tuple, sessions(batch, "user_id", "ts", "24 hours").collect()))
    assert sorted(map(tuple, spark.table("sess").collect())) == want and want


def test_hourly_counts(spark):
    got = hourly_counts(spark.read.parquet(DATA), "ts", "event_type")
    assert got.agg(F.sum("n")).first()[0] == 1000


FAR = "2040-01-01 00:00:00"
YEAR = 400 * 86_400_000_000


@pytest.fixture
def feed(spark, tmp_path):
    """A folder that events come into; put() adds a file, with a last row of its own far ahead that moves the watermark."""
    online.use_state_store(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    schema = spark.read.parquet(DATA).schema

    def put(rows, name, end=False):
        df = rows if not end else rows.unionByName(rows.limit(1).withColumns({"user_id": F.lit(-1).cast("long"), "ts": F.lit(FAR).cast(schema["ts"].dataType)}))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def stream():
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        return rows.select(F.col("user_id").alias("gid"), "ts", "event_id", (F.col("value") / 500).alias("x"), F.lit(0.0).alias("zero"), (F.col("value") > 50).alias("f"))

    return put, stream, lambda name: (str(tmp_path / f"out-{name}"), str(tmp_path / f"state-{name}"))


def halves(spark):
    rows = spark.read.parquet(DATA)
    cut = rows.selectExpr("percentile_approx(unix_micros(CAST(ts AS timestamp)), 0.5)").first()[0]
    early = F.unix_micros(F.col("ts").cast("timestamp")) <= cut
    return rows.filter(early), rows.filter(~early)


def test_stays_and_hysteresis_online_equal_the_batch_also_after_a_restart(spark, feed):
    from tidemark.plans import catalog

    put, stream, where = feed
    first, second = halves(spark)
    make = {
        "stays": lambda: online.online_stays(stream(), ["gid"], "ts", "x", "zero", 0.1, catalog.DWELL, "1 day", YEAR),
        "flags": lambda: online.online_hysteresis(stream(), ["gid"], "ts", "event_id", "f", catalog.DWELL, "1 day", YEAR),
    }
    put(first, "a")
    early = {name: online.drained(f(), *where(name)).count() for name, f in make.items()}
    put(second, "b", end=True)
    got = {name: online.drained(f(), *where(name)).filter("gid >= 0") for name, f in make.items()}
    want = {"stays": catalog.stationary(spark, SF).collect(), "flags": catalog.hysteresis(spark, SF).collect()}
    assert sorted(map(tuple, got["stays"].collect())) == sorted(map(tuple, want["stays"]))
    assert sorted(map(tuple, got["flags"].select("gid", "event_id", "f").collect())) == sorted(map(tuple, want["flags"]))
    assert 0 < early["stays"] < len(want["stays"]) and 0 < early["flags"] < len(want["flags"])


def test_late_rows_are_dropped_and_silent_keys_end(spark, feed):
    put, stream, where = feed
    row = lambda gid, at, value: spark.createDataFrame([(gid, at, value)], "user_id long, at string, value double").selectExpr("user_id", "CAST(at AS timestamp_ntz) AS ts", "value", "CAST(value AS long) AS event_id", "'view' AS event_type", "'{}' AS props")
    hour = 3_600_000_000
    for at, value in (("2024-01-01 00:00", 1.0), ("2024-01-01 02:00", 2.0), ("2024-01-01 01:00", 3.0), ("2024-01-03 00:00", 4.0)):
        put(row(7, at, value), "a")
        out = online.drained(online.online_stays(stream(), ["gid"], "ts", "x", "zero", 0.1, hour, "90 minutes", 6 * hour), *where("late"))
    put(row(7, "2024-01-01 03:00", 5.0), "late")
    put(row(8, "2024-03-01 00:00", 6.0), "end")
    out = online.drained(online.online_stays(stream(), ["gid"], "ts", "x", "zero", 0.1, hour, "90 minutes", 6 * hour), *where("late"))
    base = 1_704_067_200_000_000  # the first of January; the row out of order counts, the one of two days later doesn't
    assert [tuple(r) for r in out.collect()] == [(7, base, base + 2 * hour, 3)]


def test_heights_ahead_set_the_tolerance_online(spark, feed, tmp_path):
    rng = random.Random(4)
    rows, at = [], 0.0
    for t in range(150):
        at += rng.choice([0.0, 0.0, 0.3, 2.5])
        rows.append((1, t, at, 0.0, rng.choice([6.0, 9.0, 14.0])))
    df = spark.createDataFrame(rows, "k long, s long, x double, y double, tall double").selectExpr("*", "timestamp_seconds(s) AS ts", "s * 1000000 AS us")
    want = folds.anchored_stays(df, ["k"], "us", "x", "y", 0.25, 2_000_000, "tall")
    df.unionByName(df.limit(1).selectExpr("-1L AS k", "s", "x", "y", "tall", "TIMESTAMP '2040-01-01' AS ts", "us")).write.parquet(str(tmp_path / "tall"))
    got = online.drained(online.online_stays(spark.readStream.schema(df.schema).parquet(str(tmp_path / "tall")), ["k"], "ts", "x", "y", 0.25, 2_000_000, "1 hour", YEAR, height="tall"), str(tmp_path / "o"), str(tmp_path / "c"))
    assert sorted(map(tuple, got.filter("k > 0").collect())) == sorted(map(tuple, want.collect())) and got.count() > 3


def test_a_key_asks_its_state_once(spark):
    """one read and one write a call, whatever a key keeps; an empty frame is never told."""
    import pandas as pd
    from pyspark.sql.types import StructType

    calls, held, timers = [], {}, []

    class Value:
        def get(self):
            calls.append("get")
            return held.get(1)

        def update(self, row):
            calls.append("update")
            held[1] = row

        def clear(self):
            calls.append("clear")
            held.clear()

    class Handle:
        getValueState = staticmethod(lambda name, schema: Value())
        registerTimer = staticmethod(timers.append)

    class Watermark:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    state, result = StructType.fromDDL("last long, flag boolean, t0 long, told boolean"), StructType.fromDDL("gid long, us long, event_id long, f boolean")
    fold = online._Hysteresis(["v_us", "v_event_id", "v_f"], state, result, 10**9, flag=2, least=5_000, step_us=0)
    fold.init(Handle)
    rows = pd.DataFrame({"v_us": [9_000, 1_000, 4_000, 2_000], "v_event_id": [4, 1, 3, 2], "v_f": [True, True, None, False]})
    assert list(fold.handleInputRows((7,), iter([rows[:2], rows[2:]]), Watermark(0))) == [] and calls == ["get", "update"] and timers == [1]
    told = pd.concat(list(fold.handleExpiredTimer((7,), Watermark(4), None)))
    assert told[["gid", "us", "event_id", "f"]].astype(object).values.tolist() == [[7, 1_000, 1, True], [7, 2_000, 2, True]] and calls[2:] == ["get", "update"]
    last = pd.concat(list(fold.handleExpiredTimer((7,), Watermark(2 * 10**6), None)))
    assert [(r.us, r.event_id, r.f) for r in last.itertuples()] == [(4_000, 3, None), (9_000, 4, True)] and calls[4:] == ["get", "clear"] and not held
