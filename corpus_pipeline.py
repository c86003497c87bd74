"""Corpus pipeline: documents -> quality rules -> near-dedup -> secret scans -> mixing -> pieces.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; its result is written as Parquet in the shared checkpoint folder and read
again as the next stage's docs.  All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glosa.llm import dedup, mixing, pieces, quality, secrets
from glosa.llm.common import written
from glosa.session import read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or whose host is rejected, go."""
    return quality.quality_filter(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id."""
    return dedup.drop_near_duplicates(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; no document goes."""
    return secrets.redact_secrets(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks: a row per copy, none if not taken."""
    return mixing.mixed_rows(docs, weight=mixing.text_weight("text"))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each text, with its N best segmentations."""
    return pieces.encoded(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("minhash_dedup", dedup_stage),
    ("secret_scans", secrets_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", pieces_stage),
]

#: The last stage segments texts, which SQL cannot express; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
