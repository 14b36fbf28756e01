"""The corpus pipeline: documents in, packed training sequences out. Each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sigtide.llm import packing, pii, quality_model, quality_rules, simhash
from sigtide.llm.common import stored, table
from sigtide.llm.queries import BYTE_BPE


def drop_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules reject go."""
    return quality_rules.keep_good(docs)


def drop_by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under one half go. It learns from the labelled documents as they were before any stage."""
    return quality_model.keep_good(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return simhash.keep_one(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to the names of its kinds."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as pieces of training sequences."""
    return packing.pack(docs, BYTE_BPE)


STAGES = [
    ("quality rules", drop_by_rules),
    ("quality classifier", drop_by_classifier),
    ("SimHash near-dedup", drop_near_duplicates),
    ("PII", hide_personal_data),
    ("best-fit packing", pack_sequences),
]
#: Two stages score with a trained model and hash as SQL cannot; tests run the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
