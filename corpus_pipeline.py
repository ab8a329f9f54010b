"""From raw documents to packed training sequences: five stages, each a Parquet table for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutlake.llm import line_dedup, packing, quality_classifier, quality_rules, simhash
from cutlake.llm.common import read, staged


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.keep_good(docs)


def apply_quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below one half go; it learns from the raw table."""
    return quality_classifier.keep_good(docs, read(spark, sf_dir, "labels"), train_on=read(spark, sf_dir, "documents"))


def apply_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat stay in the first place only; every document stays."""
    return line_dedup.dedup(docs)


def apply_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash.keep_one(docs)


def apply_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin and offset of each document, or of each of its pieces."""
    return packing.pack(docs, packing.estimated_tokens(F.col("text")))


STAGES = [
    ("quality rules", apply_quality_rules),
    ("quality classifier", apply_quality_classifier),
    ("line dedup", apply_line_dedup),
    ("near dedup", apply_near_dedup),
    ("packing", apply_packing),
]

# Classifier, hashes of lines and best fit are beyond SQL; tests hold the rows against a plain model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
