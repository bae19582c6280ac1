"""Operator 11 against the library on whole texts."""

import random

import pytest
from tokenizers import Tokenizer

from tidemark.llm import queries, token_counts

SF = "/root/testdata/sf0.001"
SIGNS = ["a", "Bc", "'s", "'", "'ll", "7", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "　", "é", "中", "。", ".", ",", "<|endoftext|>", "<|", "|>", "😀", "\0"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(token_counts.default_tokenizer())


def test_query_equals_the_library(spark, tokenizer):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op11_token_counts(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        n = len(tokenizer.encode(r.text or "", add_special_tokens=False))
        assert tuple(got[r.doc_id]) == (r.doc_id, len((r.text or "").encode()), n, n > 512)


@pytest.mark.parametrize("long_chars", [1 << 16, 5])
def test_boundaries_are_safe(tokenizer, monkeypatch, long_chars):
    monkeypatch.setattr(token_counts, "LONG_CHARS", long_chars)
    monkeypatch.setattr(token_counts, "MEMO_PIECES", 50)
    rnd, counter = random.Random(3), token_counts.Counter(token_counts.default_tokenizer())
    texts = ["".join(rnd.choice(SIGNS) for _ in range(rnd.randint(0, 25))) for _ in range(3_000)]
    assert counter.counts(texts) == [len(tokenizer.encode(t, add_special_tokens=False)) for t in texts]


def test_edges(spark, tokenizer):
    long = "word, " * 60_000 + "x" * 70_000 + "中。" * 40_000
    rows = [(1, None, "a"), (1, "", "b"), (None, "Two words", "c"), (None, "Two words", "c"), (2, long, "d")]
    got = [tuple(r) for r in token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), limit=1).collect()]
    n = len(tokenizer.encode(long, add_special_tokens=False))
    assert sorted(got, key=str) == sorted([(1, 0, 0, False), (1, 0, 0, False), (None, 9, 2, True), (None, 9, 2, True), (2, len(long.encode()), n, True)], key=str)
    assert token_counts.count_tokens(spark.createDataFrame([], "doc_id string, text string")).collect() == []


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_files_take_whole_texts(spark, name):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path(name)
    texts = ["Two  words.", "ein Satz mit <|endoftext|> darin", "  中文 "]
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()}
    if name.endswith(".model"):
        want = [len(x) for x in SentencePieceProcessor(model_file=path).encode(texts)]
    else:
        want = [len(Tokenizer.from_file(path).encode(t, add_special_tokens=False)) for t in texts]
    assert [got[i] for i in range(3)] == want
