"""Archives of arrays as a data source."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.sources import npz, tables

SF = "/root/testdata/sf0.001"


@pytest.fixture
def folder(spark, tmp_path):
    tables.ship(spark)
    npz.register(spark)
    return str(tmp_path)


def vectors(rows):
    return sorted((r[0], *(None if v is None else tuple(v) for v in r[1:])) for r in rows)


def test_archives_of_numpy_are_read(spark, folder):
    np.savez(f"{folder}/a.npz", **{"3__hsv": np.arange(4, dtype="f4"), "3__cnn": np.ones(2, "f4"), "12__cnn": np.full(2, 0.5, "f4")})
    np.savez_compressed(f"{folder}/b.npz", **{"7__hsv": np.zeros(4)})
    want = [(3, (0.0, 1.0, 2.0, 3.0), (1.0, 1.0)), (7, (0.0,) * 4, None), (12, None, (0.5, 0.5))]
    assert vectors(spark.read.format("npz").load(folder).collect()) == want
    assert vectors(spark.read.format("npz").option("partition_bytes", 1).load(folder).collect()) == want
    assert spark.read.format("npz").option("partition_bytes", 1).load(folder).rdd.getNumPartitions() == 3
    assert vectors(spark.read.format("npz").option("kinds", "cnn").load(f"{folder}/a.npz").collect()) == [(3, (1.0, 1.0)), (12, (0.5, 0.5))]
    assert spark.read.format("npz").load(f"{folder}/nowhere").collect() == []


def test_what_is_written_reads_back(spark, folder):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("track"), F.when(F.col("vec_id") % 3 > 0, F.slice("embedding", 1, 5)).alias("hsv"), F.col("embedding").cast("array<float>").alias("cnn")).repartition(3)
    want = vectors(e.collect())
    put = lambda mode: e.write.format("npz").option("archive_members", 90).mode(mode).save(f"{folder}/v")
    put("append")
    read = spark.read.format("npz").load(f"{folder}/v")
    assert vectors(read.collect()) == want
    put("overwrite")
    assert vectors(spark.read.format("npz").load(f"{folder}/v").collect()) == want
    some = spark.read.format("npz").option("partition_bytes", 10_000).load(f"{folder}/v")
    assert vectors(some.filter("track >= 20 AND track < 40 AND track <> 25").collect()) == [r for r in want if 20 <= r[0] < 40 and r[0] != 25]
    assert vectors(some.filter(F.col("track").isin(1, 2, 500_000)).collect()) == [r for r in want if r[0] in (1, 2)]


def test_repeated_keys_and_a_failing_job(spark, folder):
    twice = spark.createDataFrame([(1, [0.5]), (1, [1.5]), (2, [])], "track long, cnn array<float>").coalesce(1)
    twice.write.format("npz").mode("append").save(f"{folder}/t")
    assert vectors(spark.read.format("npz").option("kinds", "cnn").load(f"{folder}/t").collect()) == [(1, (0.5,)), (1, (1.5,)), (2, ())]
    broken = twice.withColumn("track", F.when(F.col("track") == 2, F.raise_error(F.lit("no"))).otherwise(F.col("track")).cast("long"))
    with pytest.raises(Exception, match="no"):
        broken.write.format("npz").mode("append").save(f"{folder}/t")
    assert spark.read.format("npz").option("kinds", "cnn").load(f"{folder}/t").count() == 3


@pytest.mark.parametrize("size", [1 << 20, 100])
def test_strides_and_filters_of_series(spark, folder, size):
    for video, fps, n in ((1, 30.0, 95), (2, 9.0, 40), (3, 25.0, 0)):
        np.savez(f"{folder}/{video}.npz", video=np.full(n, video), frame=np.arange(n), t=np.arange(n) / fps, fps=fps)
    read = spark.read.format("npz").option("layout", "series").option("target_fps", 10).option("partition_bytes", size).schema("video long, frame long, t double, fps double").load(folder)
    want = [(v, f, f / fps, fps) for v, fps, n in ((1, 30.0, 95), (2, 9.0, 40)) for f in range(n) if f % max(1, round(fps / 10)) == 0]
    assert sorted(map(tuple, read.collect())) == want
    assert sorted(map(tuple, read.filter("frame > 30 AND video = 1").collect())) == [r for r in want if r[1] > 30 and r[0] == 1]
