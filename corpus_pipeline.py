"""Corpus pipeline: from raw documents to token ids, one operator a stage.

quality        hashed n-gram likelihood ratio (operator 4): rejected documents go
near_copies    n-gram Jaccard join (9): one document of each group stays
decontaminate  winnowing against the benchmark (6): contaminated documents go
personal_data  weak supervision (8): spans are replaced by their kind
tokenize       byte-level BPE (5): doc_id and token ids

All stages but the last return the columns of ``documents``.  Each takes what
its predecessor kept, whole; statistics are taken on that input.  Null texts
fail the quality rules, so later stages meet them only on their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskscope.llm import bpe, decontaminate, jaccard, pii, quality
from riskscope.llm.common import stored, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs)


STAGES = [
    ("quality", keep_good),
    ("near_copies", keep_one_of_each_group),
    ("decontaminate", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("tokenize", tokenize),
]

# Trained statistics, components and byte-pair merges are beyond SQL; tests
# compare run() with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written as Parquet
    and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
