"""Derived tables that know what they were made from: keys of content, fingerprints by partition, partial renewal.

content_keys() names a source by the head of its bytes, its size, and the settings that its first stage depends on; zones
that only later stages use don't change it. refresh() keeps a table derived per key (a video) up to date: it remembers a
fingerprint of each key's input rows and of the settings, makes only keys again whose fingerprint has changed, and replaces
just their partitions. A reader sees a key's rows only if they carry the fingerprint that its input has now, so rows of keys
that changed, vanished or have no result any more are never told, however a run ended.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.plans.eventlog import Zone
from tidemark.sources.tables import cut, ship

HEAD_BYTES = 8 << 20
#: Settings that detection and tracking depend on.
FIRST_STAGE = ("target_fps", "model", "conf", "imgsz", "track_buffer", "captions_every")


def settings_key(settings: dict, zones: tuple[Zone, ...] = (), version: int = 1) -> str:
    """Text of what a first stage depends on: its own settings, with 1 and 1.0 alike, and the corners of activity zones."""
    own = {k: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for k, v in settings.items() if k in FIRST_STAGE}
    corners = [[round(float(c), 3) for p in z.points for c in p] for z in zones if z.kind == "activity"]
    return json.dumps({"settings": own, "activity": corners, "version": version}, sort_keys=True, default=str)


def content_keys(files: DataFrame, settings: dict, zones: tuple[Zone, ...] = (), version: int = 1, head: int = HEAD_BYTES) -> DataFrame:
    """path, size and key (16 hexadecimal digits) of each file in the column path. Only the head of a file is read, by the
    executors; paths are those that pyarrow's file systems open."""
    ship(files.sparkSession)
    told = settings_key(settings, zones, version).encode()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tidemark.sources.npz import _opened

        for rows in batches:
            out = []
            for path in rows["path"]:
                store, where = _opened(path)
                with store.open_input_file(where) as f:
                    size = f.size()
                    digest = hashlib.sha256(f.read(min(head, size)))
                digest.update(str(size).encode())
                digest.update(told)
                out.append((path, size, digest.hexdigest()[:16]))
            yield pd.DataFrame(out, columns=["path", "size", "key"])

    return files.select("path").distinct().mapInPandas(run, "path string, size long, key string")


def fingerprints(df: DataFrame, key: str, settings: str = "") -> DataFrame:
    """key, fingerprint and n of the rows of each key, whatever their order; equal rows count as often as they come."""
    row = F.xxhash64(*(F.col(f"`{c}`") for c in sorted(df.columns)))
    sums = df.groupBy(key).agg(F.bit_xor(row).alias("x"), F.sum(F.shiftright(row, 20)).alias("s"), F.count(F.lit(1)).alias("n"))
    return sums.select(key, F.xxhash64(F.lit(settings), "x", "s", "n").alias("fingerprint"), "n")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def refresh(path: str, inputs: DataFrame, key: str, make: Callable[[DataFrame], DataFrame], settings: str = "") -> tuple[DataFrame, DataFrame]:
    """The table that make() derives from inputs per key, and the keys that were made again for it.

    make takes rows of some keys and returns rows with the column key, each key's by its own rows alone. The table lies at
    path, one partition a key; path.fingerprints says what it was made from and is written last.
    """
    spark = inputs.sparkSession
    now = cut(fingerprints(inputs, key, settings), "fingerprints")
    known = f"{path}.fingerprints"
    same = lambda a, b: F.col(f"{a}.{key}").eqNullSafe(F.col(f"{b}.{key}"))
    if _exists(spark, f"{known}/_SUCCESS"):
        before = spark.read.schema(now.schema).parquet(known)
        changed = cut(now.alias("l").join(before.alias("r"), same("l", "r") & (F.col("l.fingerprint") == F.col("r.fingerprint")), "left_anti"), "changed")
    else:
        changed = now
    some = inputs.alias("l").join(changed.alias("r"), same("l", "r"), "left_semi")
    made = make(some)
    if not changed.isEmpty():
        told = made.alias("l").join(changed.select(key, F.col("fingerprint").alias("_made_from")).alias("r"), same("l", "r")).select("l.*", "_made_from")
        told.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
    now.write.mode("overwrite").parquet(known)
    schema = StructType([*made.schema.fields, StructField("_made_from", LongType())])
    rows = spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)
    good = now.select(key, F.col("fingerprint").alias("_made_from"))
    valid = rows.alias("l").join(good.alias("r"), same("l", "r") & (F.col("l._made_from") == F.col("r._made_from")), "left_semi")
    return valid.select(*(F.col(f"`{c}`") for c in made.columns)), changed.select(key)
