"""Registered queries of the subpackage; each runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tidemark.llm import chat_format, kneser_ney, lexical, minhash, mixing, packing, quality_rules, repair, simhash, token_counts, token_orc, url_filter, warc
from tidemark.llm.common import table, write_table


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.token_archive_roundtrip(table(spark, sf_dir, "documents"))


def op2_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_roundtrip(table(spark, sf_dir, "pages"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_digest(table(spark, sf_dir, "documents"))


def op4_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op5_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.fit(url_filter.label_by_words(pages))).drop("margin")


def op6_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, said = table(spark, sf_dir, "conversations"), "</s>[INST] ok [/INST]"
    hard = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    windows = write_table(chat_format.format_windows(turns.select("conv_id", "turn", "role", "text").unionByName(hard)), "chat")
    return chat_format.digests(windows)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_search(table(spark, sf_dir, "documents"))


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return kneser_ney.classify(docs, labels).drop("text_hash")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_rules.judge(docs, quality_rules.fit(docs, labels)).drop("rule")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_damaged(table(spark, sf_dir, "conversations"))


OPERATORS = (op1_token_orc, op2_warc_salvage, op3_best_fit_packing, op4_minmax_dedup, op5_url_trees, op6_chat_windows, op7_simhash, op8_kneser_ney, op9_mix_sources, op10_quality_rules, op11_token_counts, op12_lexical_search, op13_conversation_repair)
QUERIES = {f.__name__: f for f in OPERATORS} | {"pipeline": corpus_pipeline.run}
ORACLES: dict[str, str] = {"op2_warc_salvage": warc.SQL, "op4_minmax_dedup": minhash.SQL, "op12_lexical_search": lexical.SQL, "op13_conversation_repair": repair.SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
