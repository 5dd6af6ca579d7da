"""The corpus pipeline: documents through quality rules, line dedup, near-dedup, secret scans and
packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's documents. All but the last return the columns that they were given; a
column ``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgrid.llm.common import materialise, read_table
from flowgrid.llm.line_dedup import line_dedup
from flowgrid.llm.near_dedup import drop_near_duplicates
from flowgrid.llm.packing import pack_documents
from flowgrid.llm.quality_rules import apply_quality_rules
from flowgrid.llm.secrets import redact_secrets

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _as_given(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """``changed`` with the columns of ``docs``, the count of characters made true again."""
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(docs.columns)


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; null texts are rejected."""
    return apply_quality_rules(docs)


def stage_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document with a smaller id holds go; documents stay, if need be empty."""
    return _as_given(line_dedup(docs, counts=False), docs)


def stage_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least id stays."""
    return drop_near_duplicates(docs)


def stage_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Owner-specific secrets are redacted; widely copied examples and clean texts stay."""
    return _as_given(redact_secrets(docs), docs)


def stage_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 2048 tokens."""
    return pack_documents(docs, TOKENIZER)


STAGES = [
    ("quality_rules", stage_quality),
    ("line_dedup", stage_lines),
    ("near_dedup", stage_near),
    ("secret_scan", stage_secrets),
    ("packing", stage_pack),
]

#: Signatures, classes and tokens have no SQL form; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
