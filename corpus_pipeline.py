"""The corpus pipeline: documents through toxicity, near-duplicate, secret, mixing and packing stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. Stages but the last keep the columns of
``documents``; the last returns the packed pieces.

Every decision is made row by row, so rows that share a doc_id, have none, or repeat
are judged by their own texts; extra columns stay as they are, whatever their names. A
null or empty text is not toxic, resembles nothing, holds no secret, has size 0 in the
mix (so it is taken only with whole epochs of its source) and packs to its end id. Texts
of any length are used whole. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerleaf.llm import _shared, mixing, ngram_join, packing, secrets, toxicity


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: rows whose text is predicted toxic are dropped."""
    return toxicity.keep_ordinary(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10, five words and 80 percent: of each group of similar documents the row with the smallest doc_id stays.

    Rows that share a doc_id but differ in text are documents of their own; of rows
    with equal doc_id and text the least stays. Rows without doc_id, and texts without
    words, stay.
    """
    return ngram_join.keep_one(docs)


def secrets_are_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: every secret in a text is replaced by a mark; all documents stay."""
    return secrets.redact(docs)


def sources_are_mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents stay, repeat or go as their source's target asks."""
    return mixing.mixed_documents(docs)


def documents_are_packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: the pieces of all documents in their sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxic_documents_go),
    ("ngram_join", one_of_each_group),
    ("secrets", secrets_are_masked),
    ("mixing", sources_are_mixed),
    ("packing", documents_are_packed),
]

#: The models and the tokenizer of the first and last stages are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, _shared.stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if hasattr(before, "staged_path"):
            _shared.drop(before)
    return docs
