"""What the operators share: the shared folder, written tables, words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import fresh_path, ship, table
from tidemark.sources.tables import shared_folder as shared_dir

__all__ = ["as_rows", "drop_tables", "fresh_path", "remove_tables", "shared_dir", "ship", "table", "whole_text", "width", "write_table"]

#: Characters that separate words, as a Java class and as plain characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"


def remove_tables(spark: SparkSession) -> None:
    """Removes the intermediate tables of this application; call it when no result that reads them is needed any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}")
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Settings while a table is written: Spark removes the shuffle files of the finished execution, and Python workers get their
#: rows in batches of so many bytes, where whole texts would else make batches of 64 MB.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder, which outlives any executor. The shuffles that made it are
    removed from the executors' disks with it; the session's own settings stay as they are."""
    spark = df.sparkSession
    path, before = fresh_path(spark, name), {k: spark.conf.get(k) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def as_rows(docs: DataFrame, name: str = "_row") -> DataFrame:
    """docs as one struct a row, so that columns of any name can't meet those that an operator adds; select("_row.*") undoes it."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(name))


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def width(spark: SparkSession) -> int:
    """Partitions for an explicit shuffle: the session's own setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
