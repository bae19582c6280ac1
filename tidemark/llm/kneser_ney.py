"""Operator 8: quality classifier, interpolated modified Kneser-Ney over trusted text.

Documents are scored by character n-grams over whole code points (ngram_model), whose counts grow with the trusted text:
counting, discounts, back-off and scoring are joins sharded by n-gram. Each document gets the perplexity a character of its
whole text under trusted text of the other fold. A document goes if its perplexity is above its language's threshold, the
QUANTILE over the trusted documents of that language, which are all scored out of sample.

Nulls and empties: labels with null quality or doc_id don't count, a document is trusted if all its labels say 1; languages
with fewer than LEAST_TRUSTED trusted documents, and null ones, share a model of all trusted text; a null or empty text has
a null perplexity and goes; without trusted documents all others stay. Ties: a perplexity equal to the threshold stays.
Repeated doc_ids and rows are judged one by one, equal texts of a language alike; very long texts are scored whole, in
overlapping parts; an empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import ngram_model
from tidemark.llm.common import as_rows, whole_text, write_table

LEAST_TRUSTED = 30
QUANTILE = 0.99
#: Trusted ids that may be broadcast (8 bytes each); more are joined by a shuffle of the texts.
BROADCAST_IDS = 8_000_000


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").alias("q")).filter("q = 1").select("_id")


def _flagged(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with _id where trusted, else null."""
    ids = write_table(trusted_ids(labels), "trusted")
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, F.col("doc_id") == F.col("_id"), "left")


def perplexities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text_hash, lang, n_chars and perplexity a character of each row, as a written table.

    Of each language and fold, the numbers of trusted texts and of characters reach the driver.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("text_hash"), F.col("lang").cast("string").alias("lang"), F.char_length(whole_text()).cast("long").alias("n_chars"), whole_text().alias("text"))
    rows = ngram_model.spread(rows.withColumn("fold", ngram_model.fold(F.col("text"))))
    flagged = _flagged(rows, labels)
    good = F.col("_id").isNotNull() & (F.col("n_chars") > 0)
    sizes = flagged.groupBy("lang", "fold").agg(F.count(F.when(good, 1)).alias("n"), F.sum(F.when(good, F.col("n_chars")).otherwise(0)).alias("trusted"), F.sum("n_chars").alias("chars"), F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.sum(F.when(good, F.octet_length("text").cast("long")).otherwise(0)).alias("trusted_bytes")).collect()
    trusted = {(s.lang, s.fold): s.n for s in sizes if s.n}
    if not trusted:
        return write_table(rows.drop("text", "fold").withColumn("perplexity", F.lit(None).cast("double")), "perplexity")
    of = lambda lang: [trusted.get((lang, f), 0) for f in range(ngram_model.FOLDS)]
    own = sorted(lang for lang in {s.lang for s in sizes} if lang is not None and sum(of(lang)) >= LEAST_TRUSTED and all(of(lang)))
    shared = len(own)
    number = F.coalesce(F.array_position(F.array(*map(F.lit, own)), F.col("lang")) - 1, F.lit(-1)) if own else F.lit(-1)
    key = F.when(number < 0, shared).otherwise(number).cast("int")
    # a text trains the models of the other folds, its language's and, if some language needs it, the one of all
    keys = F.array(key, F.lit(shared)) if any(s.lang not in own and s.chars for s in sizes) else F.array(key)
    trains = F.explode(F.flatten(F.transform(F.array_distinct(keys), lambda k: F.filter(F.transform(F.sequence(F.lit(0), F.lit(ngram_model.FOLDS - 1)), lambda f: F.when(f != F.col("fold"), k * ngram_model.FOLDS + f)), lambda x: x.isNotNull()))))
    model, told = ngram_model.train(flagged.filter(good).select(trains.alias("mk"), "text").coalesce(ngram_model.tasks(docs.sparkSession, sum(s.trusted_bytes for s in sizes))))
    scored = ngram_model.perplexity(rows.withColumn("key", key), model, told, ngram_model.tasks(docs.sparkSession, sum(s.bytes for s in sizes)))
    return write_table(scored.select("doc_id", "text_hash", "lang", "n_chars", "perplexity"), "perplexity")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, text_hash, lang, n_chars, perplexity, threshold and kept of each row."""
    scored = perplexities(docs, labels)
    trusted = scored.join(trusted_ids(labels).withColumnRenamed("_id", "doc_id"), "doc_id")
    cut = lambda rows: F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000))
    by = trusted.groupBy("lang").agg(cut(trusted).alias("_t"), F.count("perplexity").alias("_n")).filter(F.col("lang").isNotNull() & (F.col("_n") >= LEAST_TRUSTED)).select(F.col("lang").alias("_lang"), "_t")
    overall = trusted.agg(cut(trusted).alias("t")).first().t
    out = scored.join(by, F.col("lang") == F.col("_lang"), "left")
    threshold = F.coalesce("_t", F.lit(overall).cast("double"))
    kept = (F.col("n_chars") > 0) & F.coalesce(F.col("perplexity") <= threshold, F.lit(True))
    return out.select("doc_id", "text_hash", "lang", "n_chars", "perplexity", threshold.alias("threshold"), kept.alias("kept"))


def keep_trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier keeps, with the columns of docs."""
    gone = classify(docs, labels).filter("NOT kept").select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_hash")).distinct()
    same = F.col("_row.doc_id").cast("long").eqNullSafe(F.col("_gone")) & (F.xxhash64(whole_text("_row.text")) == F.col("_hash"))
    return as_rows(docs).join(gone, same, "left_anti").select("_row.*")
