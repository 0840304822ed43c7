"""The corpus pipeline: quality rules, near-dedup, decontamination, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept:
documents the quality rules reject go, one document of each near-duplicate group stays
(five-word shingles, 80 % of the union), documents that share a window with the benchmark go,
found secrets are replaced in the texts, and what is left is packed into sequences. All but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from usetrail.llm import decontaminate, minhash, packing, quality, secrets
from usetrail.llm.common import table, table_written
from usetrail.session import scratch_dir

#: The trained classifier decides in the first stage, so SQL cannot express run()'s rows.
ORACLE_SQL = None
SHINGLE_WORDS, NEAR_PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicated(docs, SHINGLE_WORDS, NEAR_PERCENT)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.masked(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each to the written result of the one before."""
    folder = scratch_dir(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = table_written(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
