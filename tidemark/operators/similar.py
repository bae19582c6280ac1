"""Pairs of vectors of one group, by blocks: a group of any size is dealt into blocks of BLOCK vectors or more, and each pair of
blocks is matrix products in one task, a tile of rows at a time. A vector is sent once for each block of its group, never once
for each partner, and a group has BLOCKS blocks at most, until they would hold more than MOST vectors: what is sent grows with
the vectors, not with their square. Equal vectors, SAME of them at most, are sent and scored as one, with their names."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import products, runs

BLOCK, BLOCKS, MOST, TILE, WIDE, SAME = 512, 12, 16_384, 256, 512, 256


def _by_blocks(vectors: DataFrame, group: str, name: str, vector: str, score: Callable, choose: Callable, block: int, both: bool = False) -> DataFrame:
    """a, b and c of the pairs that choose(a, b, scores, first) picks of a tile; a and b are the lists of names of its vectors,
    first is the place of a's first vector among those of b in a block with itself, else None. both: a vector is an a for all
    blocks, not for its own and later."""
    n = F.count(F.lit(1))
    blocks = F.least(F.ceil(n / F.lit(block)), F.greatest(F.lit(BLOCKS), F.ceil(n / F.lit(MOST)))).cast("int")
    sizes = vectors.groupBy(F.col(group).alias("_g")).agg(blocks.alias("_n"))
    rows = vectors.filter(F.col(vector).isNotNull()).select(F.col(group).alias("g"), F.col(name).alias("name"), F.col(vector).alias("v"))
    part = F.floor((F.row_number().over(Window.partitionBy("g", "v").orderBy("name")) - 1) / SAME)
    alike = rows.withColumn("_part", part).groupBy("g", "v", "_part").agg(F.sort_array(F.collect_list("name")).alias("names"))
    dealt = alike.join(sizes, F.col("g").eqNullSafe(F.col("_g"))).withColumn("own", F.pmod(F.xxhash64(F.col("names")[0]), F.col("_n")).cast("int"))
    each = dealt.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).select("g", F.least("own", "_j").alias("lo"), F.greatest("own", "_j").alias("hi"), "own", "names", "v")
    kind = rows.schema["name"].dataType.simpleString()

    def pairs(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pa.Table.from_batches(batches)
        found = found.take(pc.sort_indices(pc.list_element(found.column("names"), 0))).combine_chunks()
        lo, hi = key[1].as_py(), key[2].as_py()
        own, names, held = found.column("own").to_numpy(), found.column("names").combine_chunks(), found.column("v").combine_chunks()
        if len(held.value_lengths().unique()) > 1:
            raise ValueError(f"vectors of different lengths in group {key[0].as_py()}")
        m = held.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(own), -1)
        x, y = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        for mine, others in ((x, y), (y, x))[: 2 if both and lo != hi else 1]:
            others_names, other = names.take(pa.array(others)), m[others]
            for at in range(0, len(mine), TILE):
                part = mine[at : at + TILE]
                for a, b, c in choose(names.take(pa.array(part)), others_names, score(m[part], other), at if lo == hi else None):
                    yield pa.RecordBatch.from_arrays([a, b, pa.array(c, pa.float64())], ["a", "b", "c"])

    return each.groupBy("g", "lo", "hi").applyInArrow(pairs, f"a {kind}, b {kind}, c double")


def _names(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All names, how many each list has, and where they begin."""
    n = lists.value_lengths().to_numpy().astype(int)
    return lists.flatten(), n, np.cumsum(n) - n


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return (x @ y.T) / np.sqrt((x * x).sum(1)[:, None] * (y * y).sum(1)[None, :])


def overlap(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Half the shared mass of absolute values."""
    x, y = np.abs(x), np.abs(y)
    return np.stack([np.minimum(row, y).sum(1) / 2 for row in x]) if len(x) else np.zeros((0, len(y)))


def pairs_above(vectors: DataFrame, group: str, name: str, vector: str, least: float, score: Callable = cosine, block: int = BLOCK) -> DataFrame:
    """a < b and c of the pairs of a group with a score above least. They come in an order that a file holds in few bytes: the
    pairs of two vectors' names together, a vector with WIDE others, the next one with the same others again, and apart those
    whose a is of the other side."""

    def choose(a, b, scores, first):
        above = scores > least if first is None else np.triu(scores > least, first)
        (names_a, n_a, at_a), (names_b, n_b, at_b) = _names(a), _names(b)
        for at in range(0, len(n_b), WIDE):
            i, j = np.nonzero(above[:, at : at + WIDE])
            j += at
            for k, p, q in products.of(n_a[i], n_b[j]):
                if first is not None:  # of equal vectors, each pair once
                    once = (i[k] + first < j[k]) | (p < q)
                    k, p, q = k[once], p[once], q[once]
                x, y, c = names_a.take(pa.array(at_a[i[k]] + p)), names_b.take(pa.array(at_b[j[k]] + q)), scores[i[k], j[k]]
                ordered = pc.less(x, y).to_numpy(zero_copy_only=False)
                for own, other, rows in ((x, y, np.flatnonzero(ordered)), (y, x, np.flatnonzero(~ordered))):
                    yield own.take(pa.array(rows)), other.take(pa.array(rows)), c[rows]

    return _by_blocks(vectors, group, name, vector, score, choose, block)


def most_similar(vectors: DataFrame, group: str, name: str, vector: str, k: int, digits: int = 9, score: Callable = cosine, block: int = BLOCK) -> DataFrame:
    """a, b and c of the k vectors b of a's group that are most like it; scores equal in so many digits by ascending b.

    Each pair of blocks brings k for each of its vectors at most, before anything is shuffled by vector.
    """

    def choose(a, b, scores, first):
        (own, n_a, _), (other, n_b, at_b) = _names(a), _names(b)
        order = np.argsort(np.array(other.to_pylist(), dtype=object), kind="stable")
        of_a, of_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)[order]
        for at in range(0, len(of_a), TILE):
            ranked = -np.round(scores[of_a[at : at + TILE]][:, of_b], digits)
            mine = np.arange(len(ranked))
            if first is not None:  # a vector is none of its own neighbours
                ranked[mine, order.argsort()[at_b[first] + at + mine]] = np.inf
            best = np.argsort(ranked, axis=1, kind="stable")[:, : min(k, max(0, len(other) - (first is not None)))]
            i, j = np.repeat(mine, best.shape[1]), best.ravel()
            yield own.take(pa.array(at + i)), other.take(pa.array(order[j])), scores[of_a[at + i], of_b[j]]

    found = _by_blocks(vectors, group, name, vector, score, choose, block, both=True).withColumn("_c", F.round("c", digits))
    return runs.top(found, ["a"], [F.desc("_c"), "b"], k).drop("_c")
