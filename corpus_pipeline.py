"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing, sharding, each on what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from verdictlab.functions.shared import materialise
from verdictlab.llm import decontam, mixing, near_dedup, quality, sharding


def _same_columns(docs: DataFrame, out: DataFrame) -> DataFrame:
    """The columns of ``docs``, with ``n_chars`` counted anew where it is there."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failing lines."""
    judged = quality.line_rules(docs, out="__rules").filter("__rules.kept")
    return _same_columns(docs, judged.withColumn("text", F.col("__rules.text")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return near_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without contaminated documents, and without benchmark spans in the others."""
    return _same_columns(docs, decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def shard_corpus(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot."""
    return sharding.shard_rows(docs, 8)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination),
    ("mix_sources", mix_sources),
    ("shard_corpus", shard_corpus),
]

#: MinHash and the fitted placements can't be put into SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
