"""Checks that stop a comparison, and their boolean forms over catalogues."""

from __future__ import annotations

from math import floor

from pyspark.sql import Column, DataFrame, functions as F


class GateError(ValueError):
    """A check did not hold."""


def overlap_floor(a: Column | int, b: Column | int, ratio: float = 0.99):
    if isinstance(a, int):
        return floor(ratio * min(a, b))
    return F.floor(F.least(a, b) * F.lit(ratio))


def comparable(summary: DataFrame, ratio: float = 0.99) -> DataFrame:
    """``summary`` with ``least`` (ids that must be on both sides) and ``comparable``."""
    least = overlap_floor(F.col("old_total"), F.col("new_total"), ratio)
    return summary.select("old_total", "new_total", "compared", least.alias("least"), ((F.col("compared") > 0) & (F.col("compared") >= least)).alias("comparable"))


def assert_comparable(summary: DataFrame, old: dict | None = None, new: dict | None = None, ratio: float = 0.99) -> None:
    """Salts must agree where both manifests are there; enough ids must be on both sides, and at least one."""
    if old and new and (old.get("salt_check") or "") != (new.get("salt_check") or ""):
        raise GateError("the two sides have different salts")
    r = comparable(summary, ratio).first()
    if not r["comparable"]:
        raise GateError(f"{r['compared']} ids are on both sides; {r['least']} of {r['old_total']} and {r['new_total']} are needed")


def gate(summary: DataFrame, fail: bool = True) -> int:
    """Number of flips; raises if there are any and ``fail``."""
    n = summary.first()["spam_flips"]
    if fail and n:
        raise GateError(f"{n} verdicts flipped")
    return n


def flipped(summary: DataFrame) -> DataFrame:
    """``(spam_flips, fails)``: what ``gate`` decides, as a row."""
    return summary.select("spam_flips", (F.col("spam_flips") > 0).alias("fails"))


def assert_unique(df: DataFrame, col: str) -> None:
    two = df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
    if two:
        raise GateError(f"{col} {two[0][0]!r} stands for {two[0]['n']} rows")


def duplicated(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def nonempty(df: DataFrame) -> DataFrame:
    """``(n, ok)``: what ``assert_nonempty`` asks, as a row."""
    return df.agg(F.count(F.lit(1)).alias("n")).select("n", (F.col("n") > 0).alias("ok"))


def assert_nonempty(df: DataFrame, what: str = "result") -> None:
    if df.isEmpty():
        raise GateError(f"{what} is empty")


def publishable(manifest: dict) -> bool:
    return bool(manifest.get("salt_check")) and manifest.get("shard_mode") in ("identity", "email")


def is_publishable() -> Column:
    return (F.coalesce("salt_check", F.lit("")) != "") & F.col("shard_mode").isin("identity", "email")
