"""From raw documents to packed training sequences.

Each stage gets what the one before it kept, as a Parquet table, and returns rows with the
columns of the documents; the last one returns the places of all pieces in the sequences.
Cases (nulls, empty and long texts, repeated rows, empty tables, further columns) are as the
operators have them: a document without words fails the quality rules, and a document
without doc_id is no duplicate of another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veriscope.llm import mixing, packing, quality, secret_scan, simhash
from veriscope.shared import settle


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.passed(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of SimHash near-duplicates."""
    return simhash.deduplicated(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    return secret_scan.redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of the documents: a row per pass over a source and run of words."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts, packed into sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("secret_scan", secrets),
    ("source_mix", source_mix),
    ("best_fit_packing", packing_stage),
]
# Fingerprints, byte pairs and the packing plan are beyond SQL; tests/llm compares with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *middle, (_, last) = STAGES
    for _, stage in middle:
        docs = settle(stage(spark, docs, sf_dir))
    return last(spark, docs, sf_dir)
