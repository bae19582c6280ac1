"""Every name that an operator or stage gives a column of its own may be a column of the documents."""

import re
from pathlib import Path

import pytest

import corpus_pipeline
from tidemark.llm import lexical, repair, simhash, token_counts
from tidemark.llm.queries import QUERIES  # noqa: F401

ROOT = Path(__file__).resolve().parents[2]
SF = "/root/testdata/sf0.001"
DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")
#: All names in the code of the operators that a column could have: quoted words that begin with an underscore, and common ones.
OWN = sorted({w.lower() for f in (ROOT / "tidemark/llm").glob("*.py") for w in re.findall(r'"(_[A-Za-z][A-Za-z0-9_]*)"', f.read_text())} | {"size", "n", "at", "key", "fold", "text_hash", "kept", "comp", "node", "label", "take", "target", "row", "words"})


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select(*DOCUMENTS)
    return rows.selectExpr("*", *(f"concat('{name} of ', doc_id) AS `{name}`" for name in OWN))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_bring_all_columns_back(spark, docs, name):
    assert len(OWN) > 40
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
    assert out.columns == docs.columns
    rows = out.collect()
    source = {r.doc_id: r for r in docs.collect()}
    assert rows and all(r == source[r.doc_id] for r in rows)


def test_operators_ignore_them(spark, docs):
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()
    plain = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    for f in (token_counts.count_tokens, simhash.fingerprint_edits, lambda d: lexical.search(d, items)):
        assert sorted(map(str, f(docs).collect())) == sorted(map(str, f(plain).collect()))
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    more = turns.selectExpr("*", *(f"'x' AS `{n}`" for n in OWN if n != "gone"))
    assert sorted(map(tuple, repair.repair_damaged(more).collect())) == sorted(map(tuple, repair.repair_damaged(turns).collect()))
