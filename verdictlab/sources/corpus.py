"""Corpus and meta tables: reading them, and the tables that runs write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from verdictlab.functions.scalars import COLUMNS, b64, unb64
from verdictlab.operators.joins import load_verdicts
from verdictlab.sources import snapshot

CORPUS_SCHEMA = T.StructType([T.StructField("comment_id", T.LongType(), False), *[T.StructField(c, T.StringType()) for c in COLUMNS[1:]]])


def read_corpus(spark: SparkSession, src: str | dict, partitions: int = 64) -> DataFrame:
    """The eight corpus columns from a Parquet path, or from a JDBC source (a dict of options with ``lower`` and
    ``upper`` bounds of the id, which split the read into ``partitions``)."""
    if isinstance(src, str):
        df = spark.read.parquet(src)
    else:
        o = dict(src)
        low, high = o.pop("lower"), o.pop("upper")
        df = spark.read.format("jdbc").options(**o, partitionColumn="comment_id", lowerBound=low, upperBound=high, numPartitions=partitions).load()
    kind = dict(df.dtypes)["comment_id"]
    if kind.startswith("decimal"):  # unsigned ids: must fit, else the cast fails under ANSI rules
        df = df.withColumn("comment_id", F.expr("CAST(comment_id AS BIGINT)"))
    return df.select(*COLUMNS)


def read_meta(df: DataFrame, key: str) -> DataFrame:
    """``(comment_id, value)`` of one meta key; the filter reaches the source."""
    return df.filter(F.col("meta_key") == key).select("comment_id", F.col("meta_value").alias("value"))


def load_side(spark: SparkSession, source: str | tuple[DataFrame, DataFrame], max_rows_check: bool = True):
    """``(verdicts, manifest or None)`` from a snapshot path or from replay tables."""
    if isinstance(source, str):
        manifest, verdicts = snapshot.read_snapshot(spark, source, check=max_rows_check)
        return verdicts, manifest
    return load_verdicts(*source), None


def save_labelled(df: DataFrame, path: str, label: str) -> None:
    """The rows of one label, which replace those that it had; other labels stay."""
    df.withColumn("label", F.lit(label)).write.partitionBy("label").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def latest_per_label(passes: DataFrame) -> DataFrame:
    """The registry as it stands: the last pass of each label (ties: the larger sha)."""
    w = Window.partitionBy("label").orderBy(F.desc("created_at"), F.desc("git_sha"))
    return passes.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def register_pass(registry: DataFrame, new: DataFrame) -> DataFrame:
    """The registry with ``new`` put in by label."""
    return latest_per_label(registry.unionByName(new))


def write_shards(df: DataFrame, path: str) -> None:
    df.select("comment_id", "cluster", "shard").write.mode("overwrite").parquet(path)


def write_reduced(corpus: DataFrame, meta: DataFrame, chosen: DataFrame, path: str) -> None:
    """Corpus and meta rows of the chosen comments, with their ids, as two tables."""
    ids = chosen.select("comment_id").distinct()
    corpus.join(ids, "comment_id", "left_semi").write.mode("overwrite").parquet(f"{path}/corpus")
    meta.join(ids, "comment_id", "left_semi").write.mode("overwrite").parquet(f"{path}/meta")


def write_sample_tsv(df: DataFrame, path: str) -> None:
    """``comment_id, is_ham, type, reason`` and base64 of content, URL and agent, separated by tabs."""
    line = F.concat_ws("\t", F.col("comment_id").cast("string"), F.col("is_ham").cast("int").cast("string"), "type", F.coalesce("reason", F.lit("")), b64(F.col("content")), b64(F.col("author_url")), b64(F.col("agent")))
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def read_sample_tsv(spark: SparkSession, path: str) -> DataFrame:
    """The sample back; blank lines and lines of fewer than seven fields are skipped, bad base64 is empty."""
    f = F.split("value", "\t", -1)
    text = lambda i: unb64(F.get(f, F.lit(i)))
    rows = spark.read.text(path).filter((F.trim("value") != "") & (F.size(f) >= 7))
    return rows.select(
        F.get(f, F.lit(0)).cast("long").alias("comment_id"), (F.get(f, F.lit(1)) == "1").alias("is_ham"), F.get(f, F.lit(2)).alias("type"),
        F.get(f, F.lit(3)).alias("reason"), text(4).alias("content"), text(5).alias("author_url"), text(6).alias("agent"),
    )
