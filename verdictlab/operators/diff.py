"""What two sets of verdicts say differently: flips, reason changes and their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from verdictlab.functions.scalars import direction, is_spam
from verdictlab.operators.joins import compared, diff


def _flip():
    return is_spam(F.col("old_status")) != is_spam(F.col("new_status"))


def flips(d: DataFrame) -> DataFrame:
    """Ids whose spam flag differs."""
    return compared(d).filter(_flip())


def reason_diffs(d: DataFrame) -> DataFrame:
    """Same flag, other reason (null-safe; empty and null differ). A flip is never one of them."""
    return compared(d).filter(~_flip() & ~F.col("old_reason").eqNullSafe(F.col("new_reason")))


def summary(d: DataFrame) -> DataFrame:
    """One row of totals; one aggregate over the joined rows."""
    both = F.col("old").isNotNull() & F.col("new").isNotNull()
    flip = both & (is_spam(F.col("old.status")) != is_spam(F.col("new.status")))
    other = both & ~flip & ~F.col("old.reason").eqNullSafe(F.col("new.reason"))
    s = d.agg(
        F.count("old").alias("old_total"), F.count("new").alias("new_total"), F.count_if(both).alias("compared"),
        F.count_if(F.col("new").isNull()).alias("only_in_old"), F.count_if(F.col("old").isNull()).alias("only_in_new"),
        F.count_if(flip).alias("spam_flips"), F.count_if(other).alias("reason_diffs"),
    )
    share = F.when(F.col("compared") > 0, F.col("spam_flips") * 100.0 / F.col("compared")).otherwise(0.0)
    return s.withColumn("flip_percent", F.round(share, 4))


def reason_transitions(d: DataFrame) -> DataFrame:
    """Counts of reason changes from old to new, most first."""
    name = lambda c: F.coalesce(c, F.lit("(none)"))
    g = reason_diffs(d).groupBy(name(F.col("old_reason")).alias("old_reason"), name(F.col("new_reason")).alias("new_reason"))
    return g.agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "old_reason", "new_reason")


def flip_origins(labelled: DataFrame) -> DataFrame:
    """Labelled flips by origin and direction; flips without a label are left out."""
    g = labelled.filter("origin is not null").groupBy("origin", direction(F.col("new_status")).alias("direction"))
    return g.agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "origin", "direction")


def list_flips(f: DataFrame, most: int | None = 50) -> DataFrame:
    """The first ``most`` flips by id (None: all)."""
    f = f.orderBy("id")
    return f if most is None else f.limit(most)


def more_flips(f: DataFrame, most: int = 50) -> DataFrame:
    """How many flips a list of ``most`` leaves out."""
    return f.agg(F.greatest(F.count(F.lit(1)) - most, F.lit(0)).alias("more"))


def gains(d: DataFrame) -> DataFrame:
    """Newly flagged ids by rule; an id counts for each of its rules."""
    f = flips(d).filter(is_spam(F.col("new_status")))
    return f.select(F.explode_outer(F.split("new_reason", ",")).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def drift(released: DataFrame, base: DataFrame, head: DataFrame) -> DataFrame:
    """The as-released verdicts against the current baseline (harness drift) and against head."""
    one = lambda name, other: summary(diff(released, other)).select(F.lit(name).alias("pair"), "*")
    return one("released-base", base).unionByName(one("released-head", head))


def stats_json(d: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """One row ``(json)``: the counts, and flips by origin as a list of pairs; lists of single flips stay out."""
    s = summary(d)
    fields = [F.struct(*s.columns).alias("counts")]
    if labelled is not None:
        o = flip_origins(labelled).agg(F.array_sort(F.collect_list(F.struct("origin", "direction", "n"))).alias("o"))
        s = s.crossJoin(o)  # one row each
        fields.append(F.col("o").alias("flip_origins"))
    return s.select(F.to_json(F.struct(*fields)).alias("json"))
