"""Identity clusters, shards of whole clusters, and their skew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from verdictlab.functions.scalars import anchor, identity_keys, shard_of
from verdictlab.functions.shared import materialise
from verdictlab.operators.components import connected_components


def identity_clusters(df: DataFrame, split_empty_ip: bool = False) -> DataFrame:
    """``(comment_id, cluster)``: comments that share an address, e-mail or URL, directly or by others, are one
    cluster, named by its smallest key.

    Keys and comments form a bipartite graph. A key that one comment alone has can't link anything, so it is dropped
    first; each comment then links its smallest key to its others, so the graph that is contracted has keys only.
    """
    keys = materialise(identity_keys(df, split_empty_ip).distinct())
    low = keys.groupBy("comment_id").agg(F.min("key").alias("low"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    links = keys.join(shared, "key", "left_semi")
    first = links.groupBy("comment_id").agg(F.min("key").alias("first"))
    edges = links.join(first, "comment_id").select(F.col("key").alias("a"), F.col("first").alias("b")).filter("a <> b").distinct()
    comp = connected_components(edges)
    # a key that isn't shared may be the smallest of its cluster: names are taken over all keys in the end
    at = first.join(comp, F.col("first") == F.col("node"), "left").select("comment_id", F.coalesce("component", "first").alias("part"))
    named = low.join(at, "comment_id", "left").withColumn("part", F.coalesce("part", "low"))
    names = named.groupBy("part").agg(F.min("low").alias("cluster"))
    return named.join(names, "part").select("comment_id", "cluster")


def email_clusters(df: DataFrame) -> DataFrame:
    return df.select("comment_id", anchor("email").alias("cluster"))


def check_mode(mode: str, rules: tuple[str, ...] = ()) -> None:
    """E-mail clusters split comments that the any-of-three rule would link, so the two exclude each other."""
    if mode not in ("identity", "email"):
        raise ValueError(f"unknown cluster mode {mode!r}")
    if mode == "email" and "db-spam" in rules:
        raise ValueError("cluster mode 'email' needs the rule 'db-spam' off")


def mode_fits(mode: Column, rules: Column) -> Column:
    """The boolean form of ``check_mode``, over columns: the mode and the array of rules."""
    return mode.isin("identity", "email") & ~((mode == "email") & F.array_contains(rules, "db-spam"))


def assign_shards(clusters: DataFrame, n: int) -> DataFrame:
    """``(comment_id, cluster, shard)``; a cluster is never split."""
    return clusters.withColumn("shard", shard_of(F.col("cluster"), n))


def shard_sizes(shards: DataFrame, n: int) -> DataFrame:
    """Rows of each of ``n`` shards, empty ones too."""
    all_ = shards.sparkSession.range(n).select(F.col("id").cast("int").alias("shard"))
    g = shards.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))
    return all_.join(g, "shard", "left").select("shard", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))


def skew(sizes: DataFrame) -> DataFrame:
    """The largest shard's share, its ratio to an even split, and whether that is over 2."""
    a = sizes.agg(F.max("rows").alias("largest"), F.sum("rows").alias("total"), F.count(F.lit(1)).alias("shards"))
    ratio = F.col("largest") * F.col("shards") / F.col("total")
    return a.select("largest", "total", "shards", F.round(F.col("largest") / F.col("total"), 6).alias("share"), F.round(ratio, 6).alias("ratio"), (ratio > 2).alias("warn"))


def cluster_profile(clusters: DataFrame) -> DataFrame:
    """How many clusters have each size, with the largest one's share of all rows."""
    g = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    all_ = Window.partitionBy(F.lit(1))
    return g.select("size", "n", F.round(F.max("size").over(all_) / F.sum(F.col("size") * F.col("n")).over(all_), 6).alias("largest_share"))
