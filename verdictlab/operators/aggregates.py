"""Fingerprints, distributions and profiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from verdictlab.functions.scalars import is_spam, row_crc, row_hash
from verdictlab.operators.offsets import with_row_number, with_running_sum


def corpus_fingerprint(df: DataFrame, columns: tuple[str, ...], crc: bool = False) -> DataFrame:
    """One row ``(fingerprint)``: MD5 of count, sum and xor of the row hashes. It doesn't depend on the order of rows
    or on their partitions; nulls count as absent. The sum is a decimal, which can't overflow."""
    h = (row_crc if crc else row_hash)(*columns)
    a = df.select(h.alias("h")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).alias("s"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("x"))
    return a.select(F.md5(F.concat_ws(":", *(F.col(c).cast("string") for c in "nsx"))).alias("fingerprint"))


def _verdict_hash() -> Column:
    """A null reason is told from an empty one."""
    return row_hash(F.col("id"), F.col("status"), F.coalesce(F.concat(F.lit("="), "reason"), F.lit("-")))


def digest_parts(verdicts: DataFrame, by: str, *more: Column) -> DataFrame:
    """``(by, rows, s, x, more)``: count, sum and xor of the row hashes by a column. Parts fold to the digest of the whole
    (``folded_digest``), whatever the cut."""
    h = verdicts.withColumn("__h", _verdict_hash())
    return h.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("__h").cast("decimal(38,0)")).alias("s"), F.bit_xor("__h").alias("x"), *more)


def folded_digest(parts: DataFrame) -> DataFrame:
    """One row ``(fingerprint)``: that of ``content_digest`` of all rows that the parts stand for."""
    a = parts.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"), F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.bit_xor("x"), F.lit(0)).alias("x"))
    return a.select(F.md5(F.concat_ws(":", *(F.col(c).cast("string") for c in "nsx"))).alias("fingerprint"))


def content_digest(verdicts: DataFrame) -> DataFrame:
    """The fingerprint of ``(id, status, reason)``: equal for two passes that gave equal verdicts. A null reason is
    told from an empty one."""
    v = verdicts.select("id", "status", F.coalesce(F.concat(F.lit("="), "reason"), F.lit("-")).alias("reason"))
    return corpus_fingerprint(v, ("id", "status", "reason"))


def reason_distribution(df: DataFrame) -> DataFrame:
    g = df.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(1))), 4))


def catch_rate(verdicts: DataFrame) -> DataFrame:
    """Share caught, and its sampling error sqrt(p(1-p)/n)."""
    a = verdicts.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_spam(F.col("status"))).alias("caught"))
    p = F.col("caught") / F.col("n")
    return a.select("n", "caught", (F.col("n") - F.col("caught")).alias("missed"), F.round(p, 6).alias("rate"), F.round(F.sqrt(p * (1 - p) / F.col("n")), 8).alias("error"))


def catch_by_rule(verdicts: DataFrame) -> DataFrame:
    """Caught ids by rule, and their share of all; an id counts for each of its rules."""
    n = verdicts.agg(F.count(F.lit(1)).alias("total"))
    hits = verdicts.filter(is_spam(F.col("status"))).select(F.explode(F.split("reason", ",")).alias("rule"))
    g = hits.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    return g.crossJoin(n).select("rule", "n", F.round(F.col("n") / F.col("total"), 6).alias("rate"))  # one row of totals


def crosstab(verdicts: DataFrame, origins: DataFrame) -> DataFrame:
    """New verdict by historical label, with margins (null: all)."""
    o = origins.select(F.col("comment_id").cast("string").alias("id"), F.coalesce(F.nullif("reason", F.lit("")), F.lit("unflagged")).alias("origin"))
    j = verdicts.join(o, "id").select(F.when(is_spam(F.col("status")), "spam").otherwise("ham").alias("verdict"), "origin")
    return j.cube("verdict", "origin").agg(F.count(F.lit(1)).alias("n"))


def latency_profile(df: DataFrame, col: str, slow: float) -> DataFrame:
    """Median, mean, rows of ``slow`` and over, and their share of all time. The median comes from row numbers that are
    counted in range-partitioned pieces, so no task holds all values."""
    v = F.col(col)
    a = df.agg(
        F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.count_if(v >= slow).alias("slow"),
        F.sum(F.when(v >= slow, v)).alias("t"), F.sum(v).alias("all"), F.round(F.max(v), 6).alias("worst"),
    )
    ranked = with_row_number(df.filter(v.isNotNull()).select(v.alias("v")), [F.asc("v")], "at").crossJoin(a.select("n"))  # one row of totals
    middle = F.col("at").isin(F.floor((F.col("n") + 1) / 2), F.ceil((F.col("n") + 1) / 2))
    a = a.crossJoin(ranked.filter(middle).agg(F.round(F.avg("v"), 6).alias("median")))  # one row each
    return a.select("n", "median", "mean", "slow", F.round(F.coalesce(F.col("t"), F.lit(0.0)) / F.col("all"), 6).alias("slow_share"), "worst")


def half_mass(df: DataFrame, col: str, tie: str) -> DataFrame:
    """How few rows, largest first, make up half of the total: ``(n, total_rows, share)``. The running sum is taken in
    range-partitioned pieces, not in one window."""
    total = df.agg(F.sum(col).alias("s"), F.count(col).alias("total_rows"))
    run = with_running_sum(df.filter(F.col(col).isNotNull()).select(F.col(col).alias("v"), tie), [F.desc("v"), F.asc(tie)], "v")
    n = run.crossJoin(total).filter(F.col("running") - F.col("v") < F.col("s") / 2).agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(total).select("n", "total_rows", F.round(F.col("n") / F.col("total_rows"), 6).alias("share"))  # one row each


def run_counters(corpus: DataFrame, verdicts: DataFrame, seconds: float | None = None) -> DataFrame:
    """Comments seen, processed and skipped (rejected at the door); with ``seconds``, the rate per minute."""
    v = verdicts.select(F.col("id").alias("__id"))
    j = corpus.select(F.col("comment_id").cast("string").alias("id")).join(v, F.col("id") == F.col("__id"), "left")
    a = j.agg(F.count("id").alias("seen"), F.count("__id").alias("processed"), F.count_if(F.col("__id").isNull()).alias("skipped"))
    return a if seconds is None else a.withColumn("per_minute", F.round(F.col("processed") * 60 / F.lit(seconds), 1))


def counted_run(corpus: DataFrame, classify: Callable[[DataFrame], DataFrame], put: Callable[[DataFrame], None]) -> dict[str, int]:
    """Classify and write, and count on the way: ``seen`` comments, ``processed`` ones with a verdict, ``skipped`` ones
    (rejected at the door) and ``spam``. The counts are observed by the write itself, so the corpus is read once.
    ``classify`` has to give a row for each comment that it doesn't reject, without an aggregation between."""
    before, after = Observation(), Observation()
    verdicts = classify(corpus.observe(before, F.count(F.lit(1)).alias("seen")))
    put(verdicts.observe(after, F.count(F.lit(1)).alias("processed"), F.count_if(is_spam(F.col("status"))).alias("spam")))
    seen, rest = before.get["seen"], after.get
    return {"seen": seen, "processed": rest["processed"], "skipped": seen - rest["processed"], "spam": rest["spam"]}


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def false_positives(verdicts: DataFrame, origins: DataFrame) -> DataFrame:
    """Spam verdicts among comments that history left unflagged, by rule. Unflagged isn't the same as ham."""
    o = origins.filter(F.coalesce("reason", F.lit("")) == "").select(F.col("comment_id").cast("string").alias("id"))
    j = verdicts.filter(is_spam(F.col("status"))).join(o, "id").select(F.explode_outer(F.split("reason", ",")).alias("rule"))
    return j.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def throughput(df: DataFrame, ts: str, width: str) -> DataFrame:
    """Rows per time window, and each window's part of the best one. Batch form of ``streaming.throughput``."""
    g = df.groupBy(F.window(ts, width).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    best = F.max("n").over(Window.partitionBy(F.lit(1)))
    return g.select(F.col("w.start").alias("window_start"), "n", F.round(F.col("n") / best, 6).alias("of_best"))
