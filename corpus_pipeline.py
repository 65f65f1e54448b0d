"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import exact_dedup, near_dedup, packing, pii, quality_rules, shared
from tidemark.llm.chunks import vocabulary
from tidemark.llm.queries import PSEUDONYM_KEY


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned decision list rejects go."""
    labels = shared.table(spark, sf_dir, "labels")
    return quality_rules.kept(docs, labels)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    return exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near_dedup.representatives(docs, percent=80)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms."""
    shared.ship_package(spark)
    return pii.replace(docs, key=PSEUDONYM_KEY, findings=False)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are packed into sequences of 2048 tokens."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), end_id=1, room=2048)


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("PII", private),
    ("packing", packed),
]

#: Rules are learned, near duplicates linked and texts tokenized: SQL cannot express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared.staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
