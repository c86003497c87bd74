"""Registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from glosa.llm import chat, dedup, licenses, mixing, phrases, pieces, quality, repair, secrets, suffix, topk, urls, wrappers
from glosa.llm import oracles
from glosa.session import read_table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeats_report(read_table(spark, sf_dir, "documents"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(read_table(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(read_table(spark, sf_dir, "pages"))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(licenses.document_paths(read_table(spark, sf_dir, "documents")))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"  # a conversation that holds the template's own marks
    added = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return chat.chat_report(rows.unionByName(added))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_topk(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup_report(read_table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(read_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(read_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", mixing.n_words("text").alias("size"))
    docs = mixing.with_labels(docs, read_table(spark, sf_dir, "labels"))  # narrow rows meet the labels
    return mixing.mix(docs, size=F.col("size"), weight=mixing.label_weight(F.col("__quality")))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(read_table(spark, sf_dir, "documents"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract_pages(read_table(spark, sf_dir, "pages"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.damaged_report(read_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_secret_scans": op2_secret_scans,
    "op3_url_filters": op3_url_filters,
    "op4_license_scans": op4_license_scans,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_exact_topk": op6_exact_topk,
    "op7_minhash_dedup": op7_minhash_dedup,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_quality_rules": op9_quality_rules,
    "op10_mixing": op10_mixing,
    "op11_phrase_mining": op11_phrase_mining,
    "op12_html_extraction": op12_html_extraction,
    "op13_conversation_repair": op13_conversation_repair,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = dict(oracles.ORACLES)
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
