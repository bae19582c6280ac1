"""Canonical views of the driver's tables, readers and writers of the log."""

from __future__ import annotations

import atexit
import html
import shutil
import tempfile
import uuid
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import escape_html

ROOT = str(Path(__file__).resolve().parents[2])

DETECTIONS = "video_id string, t double, frame long, track long, cls string, conf double, x1 double, y1 double, x2 double, y2 double"
SERIES = "video_id string, t double, frame long, brightness double, redness double, motion double, camera_speed double"
AUDIO = "video_id string, t double, db double, tonality double"
META = "video_id string, fps double, frames long, width double, height double, duration double, stride long, step double"


def ship(spark: SparkSession) -> None:
    """Tells Python workers where this package lies."""
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{ROOT}:{known}".rstrip(":")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of our own in local mode, by application.
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode alone, one of our own where it is unset;
    the session's setting stays as it is."""
    ship(spark)
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="tidemark-")
            atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
        found = _LOCAL[app]
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, below a folder of this application."""
    return f"{shared_folder(spark)}/tidemark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: what asks it several times neither runs nor plans it again."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """df dealt by keys into partitions of about so many rows, one a core at least: what makes many rows of each is sized by what
    comes out, which Spark, that goes by what goes in, can't know."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, -(-df.count() // rows)), *keys)


def spread(df: DataFrame, rows: int) -> DataFrame:
    """df in partitions of about so many rows, one a core at least, where much work waits for each row of a small file."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as observations of subjects: gid, us (microseconds), cls, v, k, event_id and a position x, y."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("gid"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_type").alias("cls"), F.col("value").alias("v"), k.alias("k"), "event_id", (F.col("value") / 500).alias("x"), (k / 100).alias("y"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_config(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """A JSON value a file; lines: one a line, as configs of many subjects are written, which needn't have a file each."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """track, hsv and cnn of `.npz` archives with arrays named `<track>__hsv` and `<track>__cnn`; either may be missing."""
    import io

    import numpy as np
    import pandas as pd

    def load(batches):
        for rows in batches:
            for content in rows["content"]:
                held = np.load(io.BytesIO(content))
                tracks = sorted({int(n.split("__")[0]) for n in held.files})
                get = lambda t, kind: held[f"{t}__{kind}"].astype("float32").tolist() if f"{t}__{kind}" in held.files else None  # noqa: B023, E731
                yield pd.DataFrame({"track": tracks, "hsv": [get(t, "hsv") for t in tracks], "cnn": [get(t, "cnn") for t in tracks]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(load, "track long, hsv array<float>, cnn array<float>")


def write_log(log: DataFrame, path: str) -> None:
    log.write.mode("overwrite").partitionBy("video_id").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def fingerprint(df: DataFrame) -> int:
    """An order-free hash of all rows, to tell whether a derived table is still good."""
    return df.agg(F.bit_xor(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))).alias("x"), F.count(F.lit(1)).alias("n")).select(F.xxhash64("x", "n")).first()[0]


def cached(spark: SparkSession, folder: str, key: str, make) -> DataFrame:
    """The table stored under a key, made and stored if it isn't there yet."""
    path = f"{folder}/{key}"
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    where = files.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def sample_frames(frames: DataFrame, fps: str = "fps", target: float = 10.0) -> DataFrame:
    """Every stride-th frame, stride = max(1, round(fps / target))."""
    stride = F.greatest(F.lit(1), F.rint(F.col(fps) / target)).cast("long")
    return frames.filter(F.pmod(F.col("frame"), stride) == 0)


def sample_rate(seconds):
    """Frames a second that a video of this length is analysed at."""
    return F.when(seconds <= 300, 10).when(seconds <= 900, 6).when(seconds <= 1800, 4).otherwise(2)


def _cells(*cells: Column, tag: str = "td") -> Column:
    """A row of a table, with text made safe and no line ends."""
    safe = lambda c: F.regexp_replace(escape_html(F.coalesce(c.cast("string"), F.lit(""))), r"[\r\n]+", " ")
    return F.concat(F.lit("<tr>"), *(F.concat(F.lit(f"<{tag}>"), safe(c), F.lit(f"</{tag}>")) for c in cells), F.lit("</tr>"))


def report_lines(log: DataFrame, findings: DataFrame, history: DataFrame, title: str = "Report") -> DataFrame:
    """video_id, place and value: the lines of an HTML page of each video of the log, in order of place.

    findings: video_id, section, start, details. history: video_id, asked (a number), question, answer; of a question that was
    asked again the last answer stands. log: video_id, start, id, when, type, details.
    """
    last = history.groupBy("video_id", "question").agg(F.max_by(F.struct("asked", "answer"), "asked").alias("a"))
    place = lambda part, a, b: F.struct(F.lit(part).alias("part"), a.cast("double").alias("a"), b.cast("string").alias("b"))
    fixed = lambda part, text: log.select("video_id").distinct().select("video_id", place(part, F.lit(0), F.lit("")).alias("place"), text.alias("value"))
    name = F.concat(F.lit(f"{html.escape(title)} "), escape_html(F.col("video_id").cast("string")))
    parts = [
        fixed(0, F.concat(F.lit("<!DOCTYPE html><html><head><meta charset='utf-8'><title>"), name, F.lit("</title></head><body><h1>"), name, F.lit("</h1><table>"))),
        findings.select("video_id", place(1, F.col("section"), F.format_string("%020.3f", F.col("start").cast("double"))).alias("place"), _cells(F.col("section"), F.col("start"), F.col("details")).alias("value")),
        fixed(2, F.lit("</table><table>")),
        last.select("video_id", place(3, F.col("a.asked"), F.col("question")).alias("place"), _cells(F.col("question"), F.col("a.answer")).alias("value")),
        fixed(4, F.lit("</table><table>")),
        log.select("video_id", place(5, F.col("start"), F.col("id")).alias("place"), _cells(F.col("id"), F.col("when"), F.col("type"), F.col("details")).alias("value")),
        fixed(6, F.lit("</table></body></html>")),
    ]
    return reduce(DataFrame.unionByName, parts)


def write_report(path: str, lines: DataFrame) -> None:
    """A page a video below path, written by the executors: a video's lines are sorted and stream into its file."""
    spark = lines.sparkSession
    dealt = lines.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "video_id").sortWithinPartitions("video_id", "place")
    dealt.select("video_id", "value").write.mode("overwrite").partitionBy("video_id").text(path)
