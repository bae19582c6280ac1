"""Character n-grams of operator 8: interpolated modified Kneser-Ney over whole code points, sharded throughout.

An n-gram is a string of up to ORDER characters of PAD * (ORDER - 1) + text + END, as they are written. The count tables
have one row an n-gram, grow with the trusted text and never leave the executors. Each text falls into one of FOLDS folds by
its hash and is scored under the model of the other folds' trusted text, so a trusted text and its exact copies are never
scored in sample.

A log probability is a sum over the n-grams of a text: value(g) is what g adds over its back-off, plus the log of g's own
back-off weight as a context; what the model doesn't have adds nothing. Texts are dealt into blocks of about BLOCK_CHARS
characters. A block asks for each n-gram once, so an n-gram that all texts share is one row a block; the asks are joined
with the model by n-gram, and what is found returns to the block, where its texts, compressed on the way, are summed up.

Both passes over the texts take the blocks from the partitions of one plan, which has to give the same rows twice, as
Spark's own recovery of lost tasks expects it.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop_tables, write_table

ORDER = 5
FOLDS = 2
#: Before a text, after it, and in place of U+0000, which ends a string of numpy's.
PAD, END, NUL = "\U0010fffe", "\U0010ffff", "\U0010fffd"
#: Bytes of a block, characters of a packed part of it, and those worked on at a time; texts are never cut, all bound memory.
BLOCK_BYTES, PACK_CHARS, PIECE_CHARS = 1 << 27, 1 << 21, 1 << 18
#: n-grams that a worker holds before it hands them on, and codes that get a dense table.
HELD_NGRAMS, DENSE = 1 << 20, 1 << 23
#: Rows that are Python strings at a time.
ROWS = 1_000


def fold(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(FOLDS)).cast("int")


def tasks(spark, n_bytes: int) -> int:
    """Partitions for texts of so many bytes together: a block each, and one a core at least."""
    return max(math.ceil(n_bytes / BLOCK_BYTES), spark.sparkContext.defaultParallelism)


def spread(rows: DataFrame) -> DataFrame:
    """rows in at least a partition a core. A scan of fewer is dealt anew and written, as blocks need an order that stays."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else write_table(rows.repartition(cores), "texts")


class _Blocks:
    """Numbers of blocks for a task's texts in their order; both passes over the texts see the same order."""

    def __init__(self) -> None:
        self._first, self._bytes = TaskContext.get().partitionId() << 24, 0

    def of(self, texts: pa.Array) -> np.ndarray:
        ends = self._bytes + np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        starts = np.concatenate([[self._bytes], ends[:-1]]) if len(ends) else ends
        self._bytes = int(ends[-1]) if len(ends) else self._bytes
        return self._first + starts // BLOCK_BYTES


def _pieces(texts: Iterable[str]) -> Iterator[list[tuple[int, str]]]:
    """Parts (number of the text, padded text) of about PIECE_CHARS together; a long text comes in overlapping parts."""
    held, size = [], 0
    for i, text in enumerate(texts):
        padded = PAD * (ORDER - 1) + text.replace("\0", NUL) + END
        for at in range(0, len(text) + 1, PIECE_CHARS):
            held.append((i, padded[at : at + PIECE_CHARS + ORDER - 1]))
            size += len(held[-1][1])
            if size >= PIECE_CHARS:
                yield held
                held, size = [], 0
    if held:
        yield held


def _numbered(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of each code among the different ones, and these."""
    if size > DENSE:
        found, at = np.unique(codes, return_inverse=True)
        return at, found
    seen = np.zeros(size, bool)
    seen[codes] = True
    found = np.flatnonzero(seen)
    place = np.empty(size, np.int32)
    place[found] = np.arange(len(found), dtype=np.int32)
    return place[codes], found


def ngrams(parts: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Where each predicted character stands in the joined parts; per order, each position's n-gram number and the n-grams.

    The numbers of order k begin at position k - 1. An n-gram is a row of ORDER code points, zeros after the last.
    """
    points = np.frombuffer("".join(parts).encode("utf-32-le", "replace"), np.uint32)
    lengths = np.array([len(p) for p in parts])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    predicted = np.ones(len(points), bool)
    for i in range(ORDER - 1):
        predicted[starts + i] = False
    chars, alphabet = _numbered(points, 0x110000)
    grams = np.zeros((len(alphabet), ORDER), np.uint32)
    grams[:, 0] = alphabet
    ids, out = chars, [(chars, grams)]
    for k in range(1, ORDER):
        ids, codes = _numbered(ids[:-1].astype(np.int64) * len(alphabet) + chars[k:], len(grams) * len(alphabet))
        before, last = np.divmod(codes, len(alphabet))
        grams = grams[before]
        grams[:, k] = alphabet[last]
        out.append((ids, grams))
    return np.flatnonzero(predicted), out


def _hash(grams: np.ndarray) -> np.ndarray:
    h = np.zeros(len(grams), np.uint64)
    for k in range(ORDER):
        h = (h + grams[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _names(grams: np.ndarray) -> list[str]:
    return np.ascontiguousarray(grams).view(f"<U{ORDER}").ravel().tolist()


def _grams(names: list[str]) -> np.ndarray:
    return np.array(names, f"<U{ORDER}").view(np.uint32).reshape(-1, ORDER)


class _Held:
    """Different n-grams, told apart by 64-bit hashes within one worker, with their counts if they have any."""

    def __init__(self) -> None:
        self._parts, self._size, self._least = [], 0, 1 << 17

    def add(self, grams: np.ndarray, n: np.ndarray | None = None) -> None:
        self._parts.append((_hash(grams), grams) if n is None else (_hash(grams), grams, n))
        self._size += len(grams)
        if self._size > 1.5 * self._least:
            self._least = max(self._least, len(self.merged()[0]))

    def merged(self) -> list[np.ndarray]:
        """The n-grams, and their counts."""
        if len(self._parts) > 1:
            hashes = np.concatenate([x[0] for x in self._parts])
            order = np.argsort(hashes)
            hashes = hashes[order]
            starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
            columns = [np.concatenate([x[i] for x in self._parts]) for i in range(1, len(self._parts[0]))]
            self._parts = []
            self._parts = [(hashes[starts], columns[0][order[starts]], *(np.add.reduceat(n[order], starts) for n in columns[1:]))]
            self._size = len(starts)
        return list(self._parts[0][1:])

    @staticmethod
    def full(held: dict[int, _Held]) -> bool:
        """Whether all together have more than HELD_NGRAMS different ones."""
        if sum(x._size for x in held.values()) < 2 * HELD_NGRAMS:
            return False
        return sum(len(x.merged()[0]) for x in held.values()) >= HELD_NGRAMS


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, len(b), ROWS):
            yield b.slice(at, ROWS)


def _by_key(columns: list[list]) -> dict[tuple, list[int]]:
    rows: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(*columns, strict=True)):
        rows.setdefault(key, []).append(i)
    return rows


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(mk, text) to (mk, gram, n) of the highest order."""
    held: dict[int, _Held] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for mk, found in held.items():
            grams, n = found.merged()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), mk, np.int32)), pa.array(_names(grams)), pa.array(n)], ["mk", "gram", "n"])
        held.clear()

    for b in _slices(batches):
        keys, texts = (c.to_pylist() for c in b.columns)
        for (mk,), rows in _by_key([keys]).items():
            mine = held.setdefault(mk, _Held())
            for parts in _pieces(texts[i] for i in rows):
                at, orders = ngrams([p for _, p in parts])
                ids, grams = orders[-1]
                n = np.bincount(ids[at - ORDER + 1], minlength=len(grams))
                some = np.flatnonzero(n)
                mine.add(grams[some], n[some])
        if _Held.full(held):
            yield from flush()
    yield from flush()


def _rates(counts: DataFrame) -> DataFrame:
    """Discounts d1..d3 of each model; one row a model."""
    times = counts.groupBy("mk").agg(*(F.count(F.when(F.col("n") == i, 1)).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)))
    y = F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)
    d = lambda i: F.when(F.col(f"n{i}") > 0, F.greatest(F.lit(0.05), F.least(F.lit(i - 0.05), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")))).otherwise(0.75)
    return times.select("mk", *(d(i).alias(f"d{i}") for i in (1, 2, 3)))


def _discounted(counts: DataFrame) -> DataFrame:
    off = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    return counts.join(F.broadcast(_rates(counts)), "mk").withColumn("off", off).drop("d1", "d2", "d3")


def train(trusted: DataFrame) -> tuple[DataFrame, dict[int, tuple[float, float]]]:
    """The model (mk, gram, value) as a written table; of each mk the log of the pads' weights and of an unknown character.

    trusted has mk, the number of the model that a text trains, and text.
    """
    counts = write_table(trusted.mapInArrow(_count, "mk int, gram string, n long").groupBy("mk", "gram").agg(F.sum("n").alias("n")), f"ngrams-{ORDER}")
    tables = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):  # how many different characters come before
        tables[k] = write_table(tables[k + 1].groupBy("mk", F.substring("gram", 2, k).alias("gram")).agg(F.count(F.lit(1)).alias("n")), f"ngrams-{k}")
    one = _discounted(tables[1])
    whole = write_table(one.groupBy("mk").agg(F.sum("n").alias("total"), (F.sum("off") / F.sum("n") / (F.count(F.lit(1)) + 1)).alias("unknown")), "ngram-totals")
    lower = write_table(one.join(F.broadcast(whole), "mk").select("mk", "gram", ((F.col("n") - F.col("off")) / F.col("total") + F.col("unknown")).alias("p"), F.log("unknown").alias("least")), "ngrams-p1")
    lowers = [lower]
    parts = [lower.select("mk", "gram", (F.log("p") - F.col("least")).alias("value"))]
    for k in range(2, ORDER + 1):
        rows = _discounted(tables[k]).withColumn("context", F.substring("gram", 1, k - 1))
        weights = rows.groupBy("mk", "context").agg(F.sum("n").alias("total"), (F.sum("off") / F.sum("n")).alias("weight"))
        below = F.col("weight") * F.col("q")
        share = (F.col("n") - F.col("off")) / F.col("total")
        joined = rows.join(weights, ["mk", "context"]).withColumn("suffix", F.substring("gram", 2, k - 1)).join(lower.select("mk", F.col("gram").alias("suffix"), F.col("p").alias("q")), ["mk", "suffix"])
        lower = write_table(joined.select("mk", "gram", (share + below).alias("p"), F.log((share + below) / below).alias("value")), f"ngrams-p{k}")
        lowers.append(lower)
        parts += [lower.select("mk", "gram", "value"), weights.select("mk", F.col("context").alias("gram"), F.log("weight").alias("value"))]
    model = write_table(reduce(DataFrame.union, parts).groupBy("mk", "gram").agg(F.sum("value").alias("value")), "ngram-model")
    unknown = {r.mk: math.log(r.unknown) for r in whole.collect()}
    drop_tables(whole, *tables.values(), *lowers)
    pads = {r.mk: r.s for r in model.filter(F.col("gram").isin([PAD * k for k in range(1, ORDER)])).groupBy("mk").agg(F.sum("value").alias("s")).collect()}
    return model, {mk: (pads.get(mk, 0.0), u) for mk, u in unknown.items()}


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with key and text to each n-gram of a block's texts, once a key: (block, key, gram)."""
    held, blocks = {}, _Blocks()

    def flush() -> Iterator[pa.RecordBatch]:
        for (block, key), found in held.items():
            grams = found.merged()[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), block, np.int64)), pa.array(np.full(len(grams), key, np.int32)), pa.array(_names(grams))], ["block", "key", "gram"])
        held.clear()

    for b in _slices(batches):
        keys, texts, numbers = b.column("key").to_pylist(), b.column("text").to_pylist(), blocks.of(b.column("text")).tolist()
        for (block, key), rows in _by_key([numbers, keys]).items():
            if any(x != block for x, _ in held):  # the block before is full
                yield from flush()
            for parts in _pieces(texts[i] for i in rows if texts[i]):
                at, orders = ngrams([p for _, p in parts])
                for k, (ids, grams) in enumerate(orders):
                    used = np.zeros(len(grams), bool)
                    used[ids[at - k]] = True
                    held.setdefault((block, key), _Held()).add(grams[used])
        if _Held.full(held):
            yield from flush()
    yield from flush()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a text to (block, packed): compressed parts of about PACK_CHARS."""
    blocks, options = _Blocks(), pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))

    def packed(block: int, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows[0].schema, options=options) as out:
            for r in rows:
                out.write_batch(r)
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "packed"])

    for b in batches:
        sizes, numbers = np.cumsum(pc.utf8_length(b.column("text")).to_numpy()), blocks.of(b.column("text"))
        at = 0
        while at < len(b):
            upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PACK_CHARS, "right")))
            upto = min(upto, int(np.searchsorted(numbers, numbers[at], "right")))
            yield packed(int(numbers[at]), [b.slice(at, upto - at)])
            at = upto


def _summed(told: dict[tuple[int, int], tuple[int, float, float]]):
    """told: of (key, fold) the number of its value column, the log of the pads' weights and of an unknown character."""

    def run(packed: pa.Table, found: pa.Table) -> pa.Table:
        keys = found.column("key").to_numpy()
        hashes = np.concatenate([np.empty(0, np.uint64), *(_hash(_grams(b.column(0).to_pylist())) for b in found.select(["gram"]).to_batches(1 << 16))])
        values = np.stack([found.column(f"value{f}").to_numpy() for f in range(FOLDS)], axis=1)
        tables = {}
        for key in np.unique(keys).tolist():
            mine = np.flatnonzero(keys == key)
            mine = mine[np.argsort(hashes[mine])]
            tables[key] = hashes[mine], np.append(values[mine], np.zeros((1, FOLDS), values.dtype), axis=0)
        del keys, hashes, values
        out = []
        for blob in packed.column("packed"):
            rows = pa.ipc.open_stream(blob.as_buffer()).read_all()
            texts, result, folds = rows.column("text").to_pylist(), np.full(len(rows), np.nan), rows.column("fold").to_numpy()
            for (key,), mine in _by_key([rows.column("key").to_pylist()]).items():
                mine = np.array([i for i in mine if texts[i]], int)
                if (key, 0) not in told or not len(mine):
                    continue
                columns, pads, unknown = (np.array([told[key, f][i] for f in range(FOLDS)])[folds[mine]] for i in range(3))
                known, value = tables.get(key, (np.empty(0, np.uint64), np.zeros((1, FOLDS))))
                logs, value = pads + 0.0, value.ravel()
                for parts in _pieces(texts[i] for i in mine):
                    at, orders = ngrams([p for _, p in parts])
                    owner = np.repeat([i for i, _ in parts], [len(p) - ORDER + 1 for _, p in parts])
                    sums, column = unknown[owner], columns[owner]
                    for k, (ids, grams) in enumerate(orders):
                        h = _hash(grams)
                        place = np.searchsorted(known, h)
                        place[(place == len(known)) | (np.append(known, np.uint64(0))[place] != h)] = len(known)
                        sums += value[place[ids[at - k]] * FOLDS + column]
                    logs += np.bincount(owner, sums, len(mine))
                positions = np.array([len(texts[i]) + 1 for i in mine])
                result[mine] = np.exp(np.round(-logs / positions, 9))
            out.append(rows.drop(["text", "key", "fold"]).append_column("perplexity", pa.array(result, from_pandas=True)))
        return pa.concat_tables(out) if out else pa.table({})

    return run


def perplexity(rows: DataFrame, model: DataFrame, told: dict[int, tuple[float, float]], n_tasks: int) -> DataFrame:
    """rows without text, key and fold, with the perplexity a character; null for empty texts and keys without a model.

    rows has key, fold and text (no nulls); the model of key and fold has the number key * FOLDS + fold. A fold without a
    model of its own is scored under another of its key.
    """
    by = {}
    for key in {mk // FOLDS for mk in told}:
        there = [key * FOLDS + f for f in range(FOLDS) if key * FOLDS + f in told]
        by |= {(key, f): key * FOLDS + f if key * FOLDS + f in told else there[0] for f in range(FOLDS)}
    dealt = rows.coalesce(n_tasks)  # both passes take all its columns, so that both have one plan and the same blocks
    wide = model.groupBy(F.floor(F.col("mk") / FOLDS).cast("int").alias("key"), "gram").agg(*(F.coalesce(F.sum(F.when(F.col("mk") % FOLDS == f, F.col("value"))), F.lit(0.0)).cast("float").alias(f"value{f}") for f in range(FOLDS)))
    asked = dealt.mapInArrow(_ask, "block long, key int, gram string")
    found = asked.join(wide, ["key", "gram"]).select("block", "key", "gram", *(f"value{f}" for f in range(FOLDS)))
    packed = dealt.mapInArrow(_pack, "block long, packed binary")
    kept = [f for f in rows.schema.fields if f.name not in ("text", "key", "fold")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", perplexity double"
    return packed.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_summed({kf: (mk % FOLDS, *told[mk]) for kf, mk in by.items()}), schema)
