"""Operator 12 against its SQL twin and a plain loop."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tidemark.llm import lexical, queries

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    """Rows by the contract, one item and document at a time; docs may repeat a doc_id."""
    told = [(d, Counter(terms(t))) for d, t in docs]
    told = [(d, c) for d, c in told if c]
    many, total = len(told), sum(sum(c.values()) for _, c in told)
    df = Counter(t for _, c in told for t in c)
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        scored = []
        for d, c in told:
            m = 50 + (50 * sum(c.values()) * many) // total
            s = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in wanted if t in c)
            scored += [(-s, d is None, d)] if s > 0 else []
        out += [(item, i, d, -s) for i, (s, _, d) in enumerate(sorted(scored, key=lambda x: x[:2] + (x[2] or 0,))[:k], 1)]
    return out


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.op12_lexical_search(spark, SF)
    want = con.execute(queries.ORACLES["op12_lexical_search"])
    assert got.columns == [d[0] for d in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def awkward():
    rng = random.Random(5)
    words = ["the", "The", "Éa", "éa", "日本", "x1", "a\x7fb", "river", "stone", "w" * 300]
    docs = [(i % 90 if i % 17 else None, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(400)]
    docs += [(1000, None), (1001, ""), (1002, "?! ,"), (1003, "river " * 40_000), *[(2000 - i, "river stone stone") for i in range(120)]]
    items = [(1, "THE river"), (1, "stone"), (2, None), (3, "nowhere"), (4, "éa 日本, x1"), (5, "river stone"), (None, "river"), (6, "b a"), (6, "b a")]
    return docs, items


@pytest.mark.parametrize("blocks", [False, True])
def test_search_equals_a_plain_loop(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(lexical, "BLOCK_ITEMS", 2)
    docs, items = awkward()
    df = spark.createDataFrame([(d, t, "x", 3) for d, t in docs], "doc_id long, text string, rank string, score int").repartition(5)
    got = lexical.search(df, spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, tf int"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain(docs, items, 50), key=str)


def test_empty_sides(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id string, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (spark.createDataFrame([(1, None)], docs.schema), items)):
        assert lexical.search(d, i).collect() == []
    assert lexical.search(docs, items).count() == 1


def test_radix_order_is_stable():
    keys = np.random.default_rng(1).integers(0, 1 << 40, 20_000).astype(np.uint64) >> np.uint64(3)
    keys[::3] = keys[0]
    assert (lexical.radix_order(keys) == np.argsort(keys, kind="stable")).all()
    assert len(lexical.radix_order(keys[:0])) == 0
