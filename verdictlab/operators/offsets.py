"""Row numbers and running sums over a whole order, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from verdictlab.functions.shared import materialise


def _ranged(df: DataFrame, order: list[Column], partitions: int | None) -> DataFrame:
    """``df`` range-partitioned by ``order``, with its partition number (written once, so both readers agree)."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return materialise(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))


def with_row_number(df: DataFrame, order: list[Column], out: str = "n", partitions: int | None = None) -> DataFrame:
    """``df`` with the place of each row in ``order``, from 1. Rows are numbered inside ranges; each range starts where
    the ranges before it end. Ties are numbered in any order."""
    d = _ranged(df, order, partitions)
    start = _starts(d, F.count(F.lit(1)))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return d.withColumn(out, own).join(start, "__part").withColumn(out, (F.col(out) + F.col("__start")).cast("long")).drop("__part", "__start")


def with_running_sum(df: DataFrame, order: list[Column], col: str, out: str = "running", partitions: int | None = None) -> DataFrame:
    d = _ranged(df, order, partitions)
    start = _starts(d, F.sum(col))
    own = F.sum(col).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn(out, own).join(start, "__part").withColumn(out, F.col(out) + F.col("__start")).drop("__part", "__start")


def with_last_before(df: DataFrame, order: list[str], values: dict[str, Column], partitions: int | None = None) -> DataFrame:
    """``df`` with, for each name of ``values``, its last value that isn't null in the rows before, in rising ``order``
    (of equal rows, in any order). Values are carried forward inside ranges; into a range comes what the last range before
    it that has any ends with."""
    named = {f"__v{i}": c for i, c in enumerate(values.values())}
    d = _ranged(df.withColumns(named), [F.col(c) for c in order], partitions)
    rising = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*order)
    ends = d.groupBy("__part").agg(*[F.max_by(F.when(F.col(v).isNotNull(), F.col(v)), F.when(F.col(v).isNotNull(), place)).alias(v) for v in named])
    # one row per partition, so this window is over a handful of rows
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    given = ends.select("__part", *[F.last(v, ignorenulls=True).over(before).alias(f"{v}_in") for v in named])
    own = d.withColumns({name: F.last(v, ignorenulls=True).over(rising) for name, v in zip(values, named, strict=True)}).join(given, "__part")
    return own.withColumns({name: F.coalesce(F.col(name), F.col(f"{v}_in")) for name, v in zip(values, named, strict=True)}).drop("__part", *named, *[f"{v}_in" for v in named])


def _starts(d: DataFrame, what: Column) -> DataFrame:
    """``(__part, __start)``: one row per partition, so this window is over a handful of rows."""
    g = d.groupBy("__part").agg(what.alias("__w"))
    run = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return g.select("__part", F.coalesce(F.sum("__w").over(run), F.lit(0)).alias("__start"))
