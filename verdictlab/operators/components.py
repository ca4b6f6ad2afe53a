"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from verdictlab.functions.shared import materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; the component is its smallest node.

    Every step is a ``groupBy().agg(min)`` (pre-aggregated before the shuffle) and an equi-join, so a node
    with very many neighbours is never gathered into one row or one task. Each round is written to the shared
    folder; the loop ends when every edge leads from a node straight to its root.
    Edges with a null end or equal ends are ignored; no edges give no rows.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    e = materialise(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        if _settled(e):
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(small.unionByName(low.withColumnRenamed("m", "v")).distinct())
    else:
        raise RuntimeError(f"connected components did not settle in {max_rounds} rounds")
    e = e.toDF("node", "component")
    return e.unionByName(e.select(F.col("component").alias("node"), "component").distinct())


def _settled(e: DataFrame) -> bool:
    """Whether each node has one edge, to a node that has none itself."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("out")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("out")))
    n = ends.groupBy("x").agg(F.sum("out").alias("n_out"), F.count(F.lit(1)).alias("n"))
    return n.filter("n_out > 1 or (n_out = 1 and n > 1)").isEmpty()
