"""Operator 1: token ids in ORC stripes.

Documents are dealt by ranges of doc_id, encoded and written in ascending doc_id order. Every stripe holds integer
run-length encoded columns, a row index every ROW_STRIDE rows and Bloom filters on doc_id, so a reader takes stripes in
parallel, skips those whose minimum and maximum rule a document out and asks the Bloom filter about the rest.

Nulls and empties: a null or empty text has just the end id; null doc_ids come first. Ties: rows with equal doc_ids stay
separate and are ordered by the text's hash, then text, so that many of them are dealt over several parts. A very long text
is encoded whole and is one row; an empty table gives an empty, readable archive. Other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import fresh_path, whole_text
from tidemark.llm.tokens import default_tokenizer, encoder

SCHEMA = "doc_id long, start_in_part long, n_tokens long, part int, ids array<int>"
ROW_STRIDE = 1_000
STRIPE_BYTES = 16 << 20
#: Ids in one batch that goes back to the JVM; a longer document goes alone.
BATCH_IDS = 1 << 20


def id_list(parts: list[bytes]) -> pa.ListArray:
    """A list column over little-endian 32-bit ids."""
    ends = np.cumsum([0, *(len(x) // 4 for x in parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), "<i4")))


def crc32_of_ids(lists: pa.ListArray) -> list[int]:
    """Unsigned crc32 of each list as little-endian unsigned 32-bit integers."""
    values, ends = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4"), lists.offsets.to_numpy()
    view = memoryview(values).cast("B")
    return [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _encode(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at, end = encoder(tokenizer).raw, TaskContext.get().partitionId(), 0, np.uint32(end_id).tobytes()

        def batch(ids: list, raws: list, starts: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array([len(x) // 4 for x in raws], pa.int64()), pa.array([part] * len(ids), pa.int32()), id_list(raws)],
                ["doc_id", "start_in_part", "n_tokens", "part", "ids"],
            )

        for got in batches:
            ids, raws, starts, held = [], [], [], 0
            for doc, text in zip(got.column(0).to_pylist(), got.column(1), strict=True):
                raw = encode(text.as_py()) + end
                ids.append(doc), raws.append(raw), starts.append(at)
                at += len(raw) // 4
                held += len(raw) // 4
                if held >= BATCH_IDS:
                    yield batch(ids, raws, starts)
                    ids, raws, starts, held = [], [], [], 0
            if ids:
                yield batch(ids, raws, starts)

    return run


def write_token_archive(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Encodes every whole text and writes the archive at path."""
    (
        docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"), F.xxhash64(whole_text()).alias("_hash"))
        .repartitionByRange("doc_id", "_hash")  # samples of these two reach the driver, never a text
        .sortWithinPartitions("doc_id", "_hash", "text")
        .select("doc_id", "text")
        .mapInArrow(_encode(tokenizer, end_id), SCHEMA)
        .write.option("compression", "zstd")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(ROW_STRIDE))
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .orc(path)
    )


def part_offsets(spark: SparkSession, path: str) -> DataFrame:
    """Ids before each part: a running sum over one row per written file; reads no ids.

    It goes out to the scan: 12 bytes a file, so 12 MB for a million files of ids.
    """
    totals = spark.read.schema(SCHEMA).orc(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return F.broadcast(totals.select("part", F.coalesce(before, F.lit(0)).cast("long").alias("_base")))


def read_token_archive(spark: SparkSession, path: str, doc_ids: Iterable[int] | None = None, where: Column | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids; doc_ids or a condition on doc_id prunes stripes by statistics and Bloom filters."""
    rows = spark.read.schema(SCHEMA).orc(path)
    if doc_ids is not None:
        rows = rows.filter(F.col("doc_id").isin(list(doc_ids)))
    if where is not None:
        rows = rows.filter(where)
    return rows.join(part_offsets(spark, path), "part").select("doc_id", (F.col("_base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def digest(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as they were read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crc32_of_ids(b.column("ids")), pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_archive_roundtrip(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Writes the archive of docs in the shared folder and reads its digests back."""
    path = fresh_path(docs.sparkSession, "token-orc")
    write_token_archive(docs, path, tokenizer or default_tokenizer(), end_id)
    return digest(read_token_archive(docs.sparkSession, path))
