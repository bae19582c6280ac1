"""Operator 12: ranked lexical search by sort-based accumulation.

One pass over the documents writes a table of matched postings: per document its number of terms and, for the terms that any
item of the block asks for, their numbers and occurrences. From it come N, L and the document frequencies; then each task
concatenates arrays of (item, document, impact), sorts them by a packed key with a radix sort, adds up runs of one key with
reduceat and keeps the best k of each item in a heap. What the tasks keep is dealt by ranges of (item, doc_id), so that an
item of any number of candidates is spread over several tasks, which select again; a window ranks what is left.

Items are taken in blocks of at most BLOCK_ITEMS items and about BLOCK_TERMS different terms an item together; one block's
terms are what a worker holds (two numbers a term and item). More items mean more blocks, each over all documents.

The score is what the contract of the query says: weights floor(1000 ln((2N+2)/(2df+1))) in doubles, all else 64-bit integers.
Equal scores come by ascending doc_id, null doc_ids last.

Nulls and empties: a null or empty text has no terms, doesn't count for N and is found by nothing; an item without terms that
any document holds has no rows. Ties and repeated rows: each row of the documents is a document, rows with one doc_id too;
items are told apart by item_id and rows with one item_id are one item, with the terms of all its texts. Very long texts are
taken whole. Empty tables on either side give an empty result. Further columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import ship, whole_text, width, write_table

TOP = 50
#: Items of a block (numbered in 16 bits), and terms of its items together; a single item may have more.
BLOCK_ITEMS, BLOCK_TERMS = 1 << 16, 1 << 20
#: (item, document, impact) triples that are sorted at a time, and documents at most (numbered in 16 bits).
SLICE_TRIPLES, SLICE_DOCS = 1 << 21, 1 << 16
#: Texts that are Python strings at a time.
ROWS = 500
#: Characters that are no part of a term.
NO_TERM = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
_TO_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    """The terms of a text in their order, in UTF-8; only A-Z are lower-cased."""
    return text.encode("utf-8", "replace").translate(_TO_TERMS).split()


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of unsigned integers: counting sorts of 16 bits each, from the lowest."""
    order, top = np.arange(len(keys)), int(keys.max(initial=0))
    for shift in range(0, top.bit_length(), 16):
        digit = ((keys[order] if shift else keys) >> np.uint64(shift)).astype(np.uint16)
        if (digit[1:] < digit[:-1]).any():
            order = order[np.argsort(digit, kind="stable")]
    return order


def _item_terms(items: DataFrame) -> DataFrame:
    """item_id and term, once each, numbered blocks of whole items."""
    term = F.explode(F.filter(F.split(F.translate(whole_text(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), f"[{NO_TERM}]+"), lambda t: t != ""))
    return items.filter("item_id IS NOT NULL").select("item_id", term.alias("term")).distinct()


def _blocks(asked: DataFrame) -> Iterator[DataFrame]:
    """asked in blocks of at most BLOCK_ITEMS items and about BLOCK_TERMS terms; one block if that holds them all."""
    size = asked.agg(F.count(F.lit(1)).alias("terms"), F.countDistinct("item_id").alias("items")).first()
    n = max(math.ceil(size.terms / BLOCK_TERMS * 2), math.ceil(size.items / BLOCK_ITEMS * 2)) if size.terms > BLOCK_TERMS or size.items > BLOCK_ITEMS else 1
    for i in range(n if size.terms else 0):
        yield asked if n == 1 else asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i)


def _match(numbers: dict[bytes, int]):
    """Rows with doc_id and text to (doc_id, n, found, tf): the number of terms, and those of the block with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                b = batch.slice(at, ROWS)
                n, found, tf, ends = [], [], [], [0]
                for text in b.column("text").to_pylist():
                    terms = terms_of(text)
                    seen = Counter(map(numbers.get, terms))
                    seen.pop(None, None)
                    n.append(len(terms))
                    found.extend(seen)
                    tf.extend(seen.values())
                    ends.append(len(found))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, t)) for x, t in ((found, pa.int32()), (tf, pa.int64()))]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "found", "tf"])

    return run


class Best:
    """The k best of each item: highest score, then lowest doc_id, nulls last. A heap an item, its worst on top."""

    def __init__(self, k: int):
        self._k, self._heaps = k, {}

    def add(self, item, scores: np.ndarray, docs: list) -> None:
        """docs are the doc_ids of scores."""
        heap, k = self._heaps.setdefault(item, []), self._k
        if len(scores) > k:  # nothing below the k-th best score of these can stay
            some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        else:
            some = np.arange(len(scores))
        if len(heap) == k:
            some = some[scores[some] >= heap[0].score]
        for i in some.tolist():
            entry = _Entry(int(scores[i]), docs[i])
            if len(heap) < k:
                heapq.heappush(heap, entry)
            elif heap[0] < entry:
                heapq.heapreplace(heap, entry)

    def rows(self) -> list[tuple]:
        return [(item, e.doc, e.score) for item, heap in self._heaps.items() for e in heap]


class _Entry:
    """Less is worse."""

    __slots__ = ("doc", "score")

    def __init__(self, score: int, doc):
        self.score, self.doc = score, doc

    def __lt__(self, other: _Entry) -> bool:
        if self.score != other.score:
            return self.score < other.score
        if self.doc is None or other.doc is None:
            return self.doc is None and other.doc is not None
        return self.doc > other.doc


def _score(starts: np.ndarray, items: np.ndarray, weights: np.ndarray, many: int, total: int, k: int, item_ids: list, schema: pa.Schema):
    """Postings to the k best (item_id, doc_id, score) of the task. Term t is asked by items[starts[t]:starts[t + 1]]."""
    asks = np.diff(starts)

    def sums(n: np.ndarray, owner: np.ndarray, found: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items, documents and scores of a slice, by item and document; owner is each posting's document in the slice."""
        m = 50 + (50 * n * many) // total
        impact = weights[found] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[owner]))
        times = asks[found]
        at = np.repeat(starts[found] - np.cumsum(times) + times, times) + np.arange(times.sum())
        keys = items[at].astype(np.uint64) << np.uint64(16) | np.repeat(owner, times).astype(np.uint64)
        order = radix_order(keys)
        keys = keys[order]
        runs = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return (keys[runs] >> np.uint64(16)).astype(np.int64), (keys[runs] & np.uint64(0xFFFF)).astype(np.int64), np.add.reduceat(np.repeat(impact, times)[order], runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for b in batches:
            lists = b.column("found")
            ends = np.asarray(lists.offsets, np.int64)
            found, tf, ends = np.asarray(lists.flatten(), np.int64), np.asarray(b.column("tf").flatten(), np.int64), ends - ends[0]
            n, docs = np.asarray(b.column("n"), np.int64), b.column("doc_id").to_pylist()
            upto = np.concatenate([[0], np.cumsum(asks[found])])[ends]  # triples before each document
            lo = 0
            while lo < len(b):
                hi = min(lo + SLICE_DOCS, max(lo + 1, int(np.searchsorted(upto, upto[lo] + SLICE_TRIPLES, "right")) - 1), len(b))
                if upto[hi] > upto[lo]:
                    mine = slice(ends[lo], ends[hi])
                    item, doc, score = sums(n[lo:hi], np.repeat(np.arange(hi - lo), np.diff(ends[lo : hi + 1])), found[mine], tf[mine])
                    edges = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1], [True]])).tolist()
                    for a, z in zip(edges, edges[1:], strict=False):
                        some = a + np.flatnonzero(score[a:z] > 0)
                        if len(some):
                            best.add(int(item[a]), score[some], [docs[lo + d] for d in doc[some].tolist()])
                lo = hi
        rows = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array([item_ids[r[0]] for r in rows], schema.field(0).type), pa.array([r[1] for r in rows], schema.field(1).type), pa.array([r[2] for r in rows], pa.int64())], schema=schema)

    return run


def _select(k: int, schema: pa.Schema):
    """(item_id, doc_id, score) to the k best of each item of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for b in batches:
            items, docs, scores = b.column(0).to_pylist(), b.column(1).to_pylist(), np.asarray(b.column(2), np.int64)
            rows: dict = {}
            for i, item in enumerate(items):
                rows.setdefault(item, []).append(i)
            for item, mine in rows.items():
                best.add(item, scores[mine], [docs[i] for i in mine])
        found = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], schema.field(i).type) for i in range(3)], schema=schema)

    return run


def _arrow(field) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field.dataType)


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score: the k highest-scoring documents of each item, of all documents."""
    spark = docs.sparkSession
    ship(spark)
    rows, asked = docs.select("doc_id", whole_text().alias("text")), write_table(_item_terms(items), "asked")
    doc_type, item_type = rows.schema["doc_id"], asked.schema["item_id"]
    schema = pa.schema([("item_id", _arrow(item_type)), ("doc_id", _arrow(doc_type)), ("score", pa.int64())])
    told = f"item_id {item_type.dataType.simpleString()}, doc_id {doc_type.dataType.simpleString()}, score long"
    parts = []
    for block in _blocks(asked):
        by_term: dict[str, list] = {}
        for r in block.collect():  # a block's terms: bounded by BLOCK_TERMS
            by_term.setdefault(r.term, []).append(r.item_id)
        if not by_term:
            continue
        numbers = {t.encode(): i for i, t in enumerate(by_term)}
        item_ids = sorted({i for ids in by_term.values() for i in ids})
        place = {item: i for i, item in enumerate(item_ids)}
        lists = [sorted(map(place.__getitem__, ids)) for ids in by_term.values()]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        matched = write_table(rows.mapInArrow(_match(numbers), f"doc_id {doc_type.dataType.simpleString()}, n long, found array<int>, tf array<long>"), "postings")
        size = matched.agg(F.count(F.when(F.col("n") > 0, 1)).alias("many"), F.sum("n").alias("total")).first()
        if not size.total:
            continue
        df = np.zeros(len(numbers), np.int64)
        for r in matched.select(F.explode("found").alias("t")).groupBy("t").count().collect():  # a number a term of the block
            df[r.t] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * size.many + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        parts.append(write_table(matched.filter(F.size("found") > 0).mapInArrow(_score(starts, np.concatenate(lists).astype(np.int64), weights, size.many, size.total, k, item_ids, schema), told), "candidates"))
    if not parts:
        return spark.createDataFrame([], f"item_id {item_type.dataType.simpleString()}, rank int, doc_id {doc_type.dataType.simpleString()}, score long")
    few = reduce(DataFrame.union, parts).repartitionByRange(width(spark), "item_id", "doc_id").mapInArrow(_select(k, schema), told)
    best_first = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return few.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


#: DuckDB SQL of the query over benchmark and documents.
SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS place, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), size AS (SELECT count(*) AS many, sum(len(terms))::BIGINT AS total FROM words WHERE len(terms) > 0
), posting AS (SELECT place, term, count(*) AS tf FROM (SELECT place, unnest(terms) AS term FROM words) GROUP BY 1, 2
), weight AS (SELECT term, floor(1000 * ln((2 * many + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM posting, size GROUP BY term, many
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL
), scored AS (
  SELECT item_id, place, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(terms) * many) // total))))::BIGINT AS score
  FROM asked JOIN posting USING (term) JOIN weight USING (term) JOIN words USING (place), size GROUP BY item_id, place
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50
"""
