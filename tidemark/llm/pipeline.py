"""The corpus pipeline: five stages over documents, each written as Parquet and read again."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, mixing, near_dup, pii, quality
from tidemark.llm.shared import session, table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the ordinal model doesn't call good."""
    session(spark)
    return quality.good(docs, quality.fit(docs, quality.grades(table(spark, sf_dir, "labels"))))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    session(spark)
    return near_dup.keep_first(docs)


def decontam_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage."""
    session(spark)
    return decontam.remove(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and telling terms in the texts."""
    session(spark)
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents to the target weights."""
    session(spark)
    return mixing.mix(docs)


STAGES = [("quality", quality_stage), ("near_dup", near_dup_stage), ("decontam", decontam_stage), ("pii", pii_stage), ("mixing", mixing_stage)]

#: The model and the set similarity join have no SQL; the pipeline is tested stage by stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
