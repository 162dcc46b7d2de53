"""The corpus pipeline: quality rules, near duplicates, secrets, mixing, encoding.

Each stage takes the documents its predecessor kept and returns documents with the same
columns; the last returns piece ids. Stages are written as Parquet in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stayline.llm import jaccard, mixing, pieces, quality, secrets
from stayline.session import stage
from stayline.workload.registry import query


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or that the fitted trees reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    known = docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    model = quality.fit_quality(stage(quality.document_statistics(known), "statistics"), labels)
    return quality.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates."""
    return jaccard.keep_one(docs, jaccard.near_duplicates(docs))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the texts."""
    return secrets.redact(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes what each source's target asks for, up to three times over."""
    return mixing.mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_pieces and ids of each row of the mix."""
    return pieces.encode(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("mixing", mixing_sources),
    ("encoding", encoding),
]

#: Trees, bands and Viterbi paths have no SQL; tests/llm holds every stage against brute force.
ORACLE_SQL = None


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
