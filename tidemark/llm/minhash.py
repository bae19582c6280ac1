"""Operator 4: near-duplicates by min-max hashing, banding and exact confirmation.

Each permutation of the shingle hashes gives two signature values, its minimum and its maximum, so PERMUTATIONS hash
evaluations per shingle make twice as many values. BANDS bands of ROWS values are bucket keys: at a similarity of 0.8 a
pair shares no bucket with a probability of about 3e-6 and any link that is reported is confirmed on the full sets.

Documents with equal shingle sets are one class, whose least doc_id is its node. In a bucket no all-pairs join is made:
nodes are compared with a few pivots, links merge components, and only nodes in different components of a bucket go on to
the next round with eight times as many pivots, until every pair of a bucket is in one component or has been compared.
Two odd sketches differ in at most as many bits as their sets in shingles, so a pair whose sketches differ in too many
bits is no link for certain and leaves the join there; all others are confirmed on the full sets.

Nulls and empties: a null or empty text, or one without words, has an empty set and is linked with nothing; a null doc_id
is linked with nothing and stays; rows with equal doc_id are one document; an empty table gives an empty result. Further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import as_rows, whole_text, write_table

PERMUTATIONS, BANDS, ROWS = 80, 32, 5
#: Longs of the odd sketch: bit i tells whether an odd number of shingles fall on i.
SKETCH = 16
SALTS = 16
#: Members or pairs of one key that stay together in a join; a larger key is dealt into parts.
PART_ROWS = 512
PIVOTS, MORE_PIVOTS = 1, 8
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_SEEDS = np.random.default_rng(41).integers(0, 1 << 32, (2, PERMUTATIONS, 1), dtype=np.uint32)
_A, _B = _SEEDS[0] | np.uint32(1), _SEEDS[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a whole text; A-Z lower-cased."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    words = min(words, len(h))
    s = h[: len(h) - words + 1] + np.uint64(words)
    for i in range(1, words):
        s = _mixed(s) * _MIX[0] + h[i : len(h) - words + 1 + i]
    return np.unique(_mixed(s))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum and maximum under each permutation, next to each other."""
    low, high = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32), np.zeros(PERMUTATIONS, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 8192):
        under = _A * x[None, at : at + 8192] + _B
        low, high = np.minimum(low, under.min(axis=1)), np.maximum(high, under.max(axis=1))
    return np.stack([low, high], axis=1).reshape(-1)


def band_keys(values: np.ndarray) -> np.ndarray:
    rows = values.astype(np.uint64).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = _mixed(key * _MIX[0] + rows[:, i])
    return key.view(np.int64)


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    odd = np.bincount((shingles & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets by their signatures."""
    return float(np.mean(a == b))


def _sign(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, digests, keys, sketches = [], [], [], []
            for text in b.column(1):
                s = shingle_set(text.as_py(), words)
                counts.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(band_keys(signature(s)) if len(s) else np.empty(0, np.int64))
                sketches.append(odd_sketch(s))
            ends = np.cumsum([0, *map(len, keys)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)))
            odd = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1) * SKETCH, pa.int32()), pa.array(np.concatenate(sketches) if sketches else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), lists, odd], ["doc_id", "n_shingles", "set_id", "keys", "sketch"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), words).view(np.int64) for t in b.column(1)]
            ends = np.cumsum([0, *map(len, sets)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64)))], ["node", "shingles"])

    return run


def _salt(column: str):
    return F.pmod(F.xxhash64(column), F.lit(SALTS))


def _spread(df: DataFrame) -> DataFrame:
    """Every row once for each salt; for the small side of a join whose keys may be hot."""
    return df.withColumn("_salt", F.explode(F.array(*(F.lit(i).cast("long") for i in range(SALTS)))))


def components(edges: DataFrame) -> DataFrame:
    """node and comp, the least node reachable, of every node of edges (a, b); labels spread and jump until they stay."""
    both = write_table(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "cc-edges")
    labels = write_table(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp"), F.lit(True).alias("changed")), "cc-labels")
    while not labels.filter("changed").isEmpty():
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        hooked = write_table(labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp")), "cc-hooked")
        root = hooked.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
        labels = write_table(hooked.join(root, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp"), (F.coalesce("root", "comp") != F.col("old")).alias("changed")), "cc-labels")
    return labels.select("node", "comp")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union. Hot a's are salted."""
    parts = pairs.groupBy("a").agg((1 + F.floor(F.count(F.lit(1)) / PART_ROWS)).alias("parts"))
    held = sets.join(parts, F.col("node") == F.col("a")).select("a", F.col("shingles").alias("_x"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("_salt"))
    dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("_salt"))
    asked = dealt.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("_y")), "b")
    both = F.size(F.array_intersect("_x", "_y"))
    return held.join(asked, ["a", "_salt"]).filter(100 * both >= percent * (F.size("_x") + F.size("_y") - both)).select("a", "b").distinct()


def signed(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, set_id (null for an empty set) and bucket keys of each row, as a written table."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return write_table(rows.mapInArrow(_sign(words), "doc_id long, n_shingles long, set_id binary, keys array<long>, sketch array<long>"), "minhash")


def linked_nodes(docs: DataFrame, signs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(classes: set_id, node, n) and (components: node, comp) of the nodes that have a link to a different text."""
    full = signs.filter("set_id IS NOT NULL AND doc_id IS NOT NULL")
    classes = write_table(full.groupBy("set_id").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n")), "classes")
    heads = full.select("set_id", F.col("doc_id").alias("node"), "keys", "n_shingles", "sketch").join(classes.select("set_id", "node"), ["set_id", "node"])
    heads = write_table(heads.dropDuplicates(["set_id", "node"]).select("node", F.col("n_shingles").alias("size"), "sketch", "keys"), "heads")
    keyed = heads.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    members = write_table(keyed.withColumn("_salt", _salt("node")).join(_spread(shared), ["key", "_salt"]).select("key", "node"), "buckets")
    wanted = members.select(F.col("node").alias("doc_id")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).join(wanted, "doc_id", "left_semi")
    sets = write_table(rows.mapInArrow(_sets(words), "node long, shingles array<long>"), "shingle-sets")
    labels, pivots, turn = None, PIVOTS, 0
    bucket = members.join(heads.select("node", "size", "sketch"), "node").withColumn("comp", F.col("node"))
    few = (100 - percent) / (100 + percent)
    while True:
        sizes = bucket.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("node").alias("least")).filter("lo <> hi").select("key", "n", "least")
        sized = bucket.withColumn("_salt", _salt("node")).join(_spread(sizes), ["key", "_salt"])
        if turn == 0:
            chosen = F.col("node") == F.col("least")
        else:  # the same nodes in all buckets of one size
            chosen = F.pmod(F.xxhash64(F.lit(5), "node"), F.lit(1 << 30)) * F.col("n") < F.lit(pivots << 30)
        # a bucket of many members is dealt into parts, and its pivots go to each
        parts = 1 + F.floor(F.col("n") / PART_ROWS)
        open_now = write_table(sized.select("key", "node", "comp", parts.alias("parts"), F.pmod(F.xxhash64("node"), parts).alias("_salt"), "size", "sketch", chosen.alias("pivot")), "open-buckets")
        if open_now.isEmpty():
            return classes, labels if labels is not None else components(members.limit(0).select(F.col("node").alias("a"), F.col("node").alias("b")))
        to_all = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("_salt")
        asking = open_now.filter("pivot").select("key", F.col("node").alias("a"), F.col("comp").alias("_c"), F.col("size").alias("_n"), F.col("sketch").alias("_s"), to_all)
        differ = sum((F.bit_count(F.get("sketch", F.lit(i)).bitwiseXOR(F.get("_s", F.lit(i)))) for i in range(1, SKETCH)), F.bit_count(F.get("sketch", F.lit(0)).bitwiseXOR(F.get("_s", F.lit(0)))))
        may_link = (F.col("comp") != F.col("_c")) & (F.col("a") != F.col("node")) & ~(F.col("pivot") & (F.col("a") > F.col("node"))) & (differ <= few * (F.col("size") + F.col("_n")) + 1e-6)
        pairs = asking.join(open_now, ["key", "_salt"]).filter(may_link).select("a", F.col("node").alias("b")).distinct()
        edges = confirm(write_table(pairs, "pairs"), sets, percent)
        if labels is None:
            labels = components(edges)
        else:
            up = lambda side: labels.select(F.col("node").alias(side), F.col("comp").alias(f"_{side}"))
            lifted = edges.join(up("a"), "a", "left").join(up("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
            merged = components(lifted)
            every = labels.union(merged.join(labels, "node", "left_anti").select("node", F.col("node").alias("comp")))
            labels = write_table(every.join(merged.select(F.col("node").alias("comp"), F.col("comp").alias("top")), "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")), "labels")
        rest = open_now.filter("NOT pivot").select("key", "node", "size", "sketch", F.col("comp").alias("_old"))
        bucket = rest.join(labels, "node", "left").select("key", "node", "size", "sketch", F.coalesce("comp", "_old").alias("comp"))
        pivots, turn = pivots * MORE_PIVOTS, turn + 1


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable) and kept of each row."""
    signs = signed(docs, words)
    classes, labels = linked_nodes(docs, signs, words, percent)
    of_class = classes.join(labels, "node", "left").select("set_id", F.coalesce("comp", "node").alias("comp"), "n", "node")
    telling = _spread(of_class.filter("n > 1 OR comp <> node").select("set_id", "comp"))
    rows = signs.select("doc_id", "n_shingles", "set_id").withColumn("_salt", _salt("doc_id"))
    found = rows.join(telling, ["set_id", "_salt"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id")).alias("component_id"))
    # rows with one doc_id but different texts are one document
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without those that are near-copies of a kept one, with the columns of docs."""
    gone = near_duplicates(docs, words, percent).filter("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return as_rows(docs).join(gone, F.col("_row.doc_id").cast("long") == F.col("_gone"), "left_anti").select("_row.*")


#: DuckDB SQL of the query (two words, 80 %): all pairs that share a shingle, and who can be reached.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS g FROM w), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.b, r.reached FROM r JOIN e ON e.a = r.doc_id)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, m AS component_id, w.doc_id = m AS kept FROM w JOIN (SELECT doc_id, min(reached) AS m FROM r GROUP BY doc_id) USING (doc_id) LEFT JOIN n USING (doc_id)
"""
