"""Operator 3: best-fit decreasing packing with a segment tree over remaining capacities.

Best-fit decreasing takes pieces by falling length and puts each into the tightest open bin. Bins with equal remaining
capacity are interchangeable and so are pieces of equal length, so the plan needs only the number of pieces of each
length: at most `capacity` numbers, whatever the size of the corpus. The driver runs the exact algorithm over those
counts, finding the tightest bin in a segment tree over the remaining capacities, and writes down runs of equal
placements. A piece finds its place from its length and its rank among pieces of that length; ranks come from a local
rank within each written part and a window over (length, part) counts, so no group of pieces meets in one task.

Nulls and empties: a null or empty text is one piece with the end id alone; null and repeated doc_ids are separate
pieces; an empty table packs into no sequence. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import whole_text, write_table
from tidemark.llm.token_orc import BATCH_IDS, crc32_of_ids, id_list
from tidemark.llm.tokens import default_tokenizer, encoder

PIECES = "doc_id long, piece int, start long, length int, part int, local_rank long, ids array<int>"


class CapacityTree:
    """Segment tree over capacities 0..size; a leaf holds how many open bins have that much room."""

    def __init__(self, size: int):
        self.base = 1 << size.bit_length()
        self.sums = [0] * (2 * self.base)

    def add(self, capacity: int, bins: int) -> None:
        at = self.base + capacity
        while at:
            self.sums[at] += bins
            at >>= 1

    def tightest(self, need: int) -> int | None:
        """The least capacity of at least `need` that some bin has."""
        at = self.base + need
        if self.sums[at]:
            return need
        while at > 1 and not (at % 2 == 0 and self.sums[at + 1]):
            at >>= 1
        if at <= 1:
            return None
        at += 1
        while at < self.base:
            at = 2 * at if self.sums[2 * at] else 2 * at + 1
        return at - self.base


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, first bin, pieces in a bin, offset in the bin), in order of length and rank.

    The piece of rank r in such a run is in bin first + (r - rank) // per_bin, at offset + (r - rank) % per_bin * length.
    """
    tree, open_bins, plan, n_bins = CapacityTree(capacity), defaultdict(list), [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            open_bins[room].append((first, n))
            tree.add(room, n)

    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} doesn't fit {capacity}")
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                first, n = n_bins, -(-left // (capacity // length))
                n_bins, room = n_bins + n, capacity
            else:
                first, n = open_bins[room].pop()
                tree.add(room, -n)
            # a bin that took a piece is tighter than it was: it goes on until no more fit
            fit = room // length
            full = min(n, left // fit)
            if full:
                plan.append((length, rank, first, fit, capacity - room))
                put(room - fit * length, first, full)
                rank, left = rank + full * fit, left - full * fit
            if full < n:
                if left < fit and left:
                    plan.append((length, rank, first + full, left, capacity - room))
                    put(room - left * length, first + full, 1)
                    rank, left, full = rank + left, 0, full + 1
                put(room, first + full, n - full)
    return plan


def _cut(tokenizer: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, end, seen = encoder(tokenizer).raw, TaskContext.get().partitionId(), np.uint32(end_id).tobytes(), defaultdict(int)

        def batch(rows: list, raws: list) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)), id_list(raws)], ["doc_id", "piece", "start", "length", "part", "local_rank", "ids"])

        for got in batches:
            rows, raws, held = [], [], 0
            for doc, text in zip(got.column(0).to_pylist(), got.column(1), strict=True):
                raw = encode(text.as_py()) + end
                for i, at in enumerate(range(0, len(raw), 4 * capacity)):
                    raws.append(cut := raw[at : at + 4 * capacity])
                    length = len(cut) // 4
                    rows.append((doc, i, at // 4, length, part, seen[length]))
                    seen[length] += 1
                    held += length
                if held >= BATCH_IDS:
                    yield batch(rows, raws)
                    rows, raws, held = [], [], 0
            if rows:
                yield batch(rows, raws)

    return run


def cut_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Whole texts as pieces of at most `capacity` ids, written to the shared folder with their rank in their part."""
    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    return write_table(rows.mapInArrow(_cut(tokenizer or default_tokenizer(), capacity, end_id), PIECES), "pieces")


def place(pieces: DataFrame, keyed: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to `keyed`, which has length, part and local_rank of the pieces.

    To the driver come at most `capacity` counts.
    """
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    plan = best_fit_plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    table = np.array(plan, np.int64).reshape(-1, 5)
    by_length = {int(x): table[table[:, 0] == x] for x in np.unique(table[:, 0])}
    ranked = keyed.join(bases, ["length", "part"]).withColumn("_rank", F.col("_base") + F.col("local_rank")).drop("_base", "part", "local_rank")
    names = [c for c in ranked.columns if c != "_rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            bins, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for x in np.unique(length):
                mine, runs = length == x, by_length[int(x)]
                r = rank[mine]
                run = runs[np.searchsorted(runs[:, 1], r, "right") - 1]
                bins[mine], offset[mine] = run[:, 2] + (r - run[:, 1]) // run[:, 3], run[:, 4] + (r - run[:, 1]) % run[:, 3] * x
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(bins), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the crc32 of their ids in place of the ids."""
    keep = ["doc_id", "piece", "start", "length", "part", "local_rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(crc32_of_ids(b.column("ids")), pa.int64())], [*keep, "ids_crc32"])

    return pieces.mapInArrow(run, "doc_id long, piece int, start long, length int, part int, local_rank long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Every piece with its ids and its place: doc_id, piece, start, length, ids, sequence_id, offset."""
    pieces = cut_pieces(docs, tokenizer, capacity, end_id)
    return place(pieces, pieces, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, ids, and of each piece in them doc_id, piece, offset and length."""
    part = F.struct("offset", "length", "doc_id", "piece", "ids")
    return packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.transform("p", lambda x: x.dropFields("ids")).alias("pieces"))


def pack_digest(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Every piece with the crc32 of its ids and its place; the ids stay out of the join."""
    pieces = cut_pieces(docs, tokenizer, capacity, end_id)
    return place(pieces, digest(pieces), capacity).select("doc_id", "piece", "start", F.col("length").cast("long"), "ids_crc32", "sequence_id", "offset")
