"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again.

Every stage takes null and empty texts, texts of any length, repeated rows, empty
tables and further columns of any name: what it does with them is stated by the operator
it calls.  Ids are integers or null.  All stages but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from samewise.llm.decontaminate import without_leaks
from samewise.llm.line_dedup import without_repeated_lines
from samewise.llm.near_dedup import keep_one
from samewise.llm.quality import accepted
from samewise.llm.sentencepiece import encode
from samewise.llm.tables import small_batches, table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the weak-label classifier accepts."""
    small_batches(spark)
    return accepted(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat across documents, but for one place of each."""
    return without_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every near-duplicate group: five-word shingles, a likeness of 0.8 or more."""
    small_batches(spark)
    return keep_one(docs, k=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that leak no benchmark item."""
    small_batches(spark)
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to its text."""
    small_batches(spark)
    return encode(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("sentencepiece", tokens),
]

#: Trained models, MinHash groups and tilings cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents in order."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
