"""Deterministic samples: first rows per group, even strides per stratum, systematic samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from verdictlab.functions.scalars import norm_type, origin_label, script_class
from verdictlab.functions.shared import materialise
from verdictlab.operators.offsets import with_row_number

STRATUM = ["old_reason", "new_reason", "type", "script"]


def top_n_per_group(df: DataFrame, keys: list[str], n: int, id_: str = "comment_id") -> DataFrame:
    """Up to ``n`` rows per group, by id. Spark limits each group below the shuffle, so hot groups stay small."""
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(id_))
    return df.withColumn("k", k).filter(F.col("k") <= n)


def strata(corpus: DataFrame, origins: DataFrame, snapshot_reason: DataFrame) -> DataFrame:
    """``(comment_id, old_reason, new_reason, type, script)``: historical label, another build's reason, type, script."""
    d = corpus.join(origins, "comment_id", "left").join(snapshot_reason, "comment_id", "left")
    return d.select(
        "comment_id", origin_label(F.col("reason"), "ham").alias("old_reason"), F.coalesce("snapshot_reason", F.lit("(unclassified)")).alias("new_reason"),
        norm_type(F.col("type")).alias("type"), script_class(F.col("content")).alias("script"),
    )


def stratified_sample(df: DataFrame, cap: int, capped: Column | None = None, keys: list[str] = STRATUM, id_: str = "comment_id") -> DataFrame:
    """Even strides over the strata that ``capped`` tells (default: the decoy strata), all rows of the others.

    A stratum of more than ``cap`` rows keeps the places floor(i * (size / cap)), i from 0, in id order. Rows are
    numbered over one range-partitioned order of (stratum, id), so a stratum of most of the corpus is spread over many
    tasks; whether a row's place is one of those is tested by arithmetic on the row, not by a join.
    """
    capped = F.col("old_reason") == "css" if capped is None else capped
    size = materialise(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")))
    run = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)  # one row per stratum
    starts = size.withColumn("start", F.coalesce(F.sum("size").over(run), F.lit(0)))
    n = with_row_number(df, [F.col(c) for c in [*keys, id_]], "n")
    d = n.join(starts, keys).withColumn("place", F.col("n") - 1 - F.col("start"))
    # place p is kept if some i has floor(i * stride) = p; only the few i next to p / stride can
    stride = F.col("size") / F.lit(float(cap))
    near = F.floor(F.col("place") / stride)
    hit = F.exists(F.array(*[near + j for j in (-1, 0, 1, 2)]), lambda i: (i >= 0) & (i < cap) & (F.floor(i * stride) == F.col("place")))
    return d.filter(~capped | (F.col("size") <= cap) | hit).drop("n", "start", "place", "size")


def strata_report(df: DataFrame, kept: DataFrame, keys: list[str] = STRATUM, id_: str = "comment_id") -> DataFrame:
    k = kept.select(F.col(id_).alias("__k"))
    j = df.join(k, F.col(id_) == F.col("__k"), "left")
    return j.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), F.count("__k").alias("kept"))


def type_counts(df: DataFrame, group: str = "reason") -> DataFrame:
    """``(group, rows, types)`` with the types as text, such as ``comment x10, trackback x9``."""
    g = df.groupBy(group, "type").agg(F.count(F.lit(1)).alias("n"))
    text = F.concat("type", F.lit(" x"), F.col("n"))
    return g.groupBy(group).agg(F.sum("n").alias("rows"), F.array_join(F.array_sort(F.collect_list(text)), ", ").alias("types"))


def renumber(df: DataFrame, order: list[str], out: str = "new_id") -> DataFrame:
    """Ids 1..N in the order of ``order``, from range-partitioned pieces."""
    return with_row_number(df, [F.col(c) for c in order], out)


def rotate(df: DataFrame, bodies: list[str], index: str = "n", out: str = "body") -> DataFrame:
    """A text of ``bodies`` by turns."""
    return df.withColumn(out, F.element_at(F.array(*[F.lit(b) for b in bodies]), (F.pmod(F.col(index), F.lit(len(bodies))) + 1).cast("int")))


def systematic_sample(df: DataFrame, k: int, id_: str = "comment_id") -> DataFrame:
    return df.filter(F.pmod(F.col(id_), F.lit(k)) == 0)


def limit_per_shard(df: DataFrame, n: int, id_: str = "comment_id") -> DataFrame:
    return top_n_per_group(df, ["shard"], n, id_).drop("k")
