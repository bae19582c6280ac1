"""A corpus pipeline of five stages, each over all that the one before kept.

run() writes what a stage returns as Parquet in the shared folder and reads it again for the next, so a lost executor costs
tasks, not stages.

All stages: rows with a null doc_id, lang or source take part like others (null is a language and a source of its own kind);
repeated rows are judged alike; long texts are taken whole; further columns of any name come through unchanged up to the last
stage; an empty table stays empty. A null or empty text goes at the classifier, and so never reaches the later stages, which
would each keep or drop it as their modules state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import kneser_ney, minhash, mixing, packing, quality_rules
from tidemark.llm.common import fresh_path, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose perplexity under trusted text is above their language's threshold."""
    return kneser_ney.keep_trusted(docs, table(spark, sf_dir, "labels"))


def rule_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base rule or the learned list rejects."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-copies: five-word shingles, similarity 0.8."""
    return minhash.keep_one_of_each(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in sequences of 2048 tokens."""
    return packing.pack_digest(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", rule_filter),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: SQL can't express the stages; tests hold their decisions against plain loops, the classifier's scores against a plain model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        out = stage(spark, docs, sf_dir)
        out.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
