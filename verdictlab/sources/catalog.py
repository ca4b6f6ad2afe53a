"""Catalogue of snapshot manifests: which one may be reused, and why not."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from verdictlab.operators.gates import GateError


def usable(catalog: DataFrame, schema: int, commit_sha: str, salt_check: str) -> DataFrame:
    """``catalog`` with ``refusal``: the first condition that doesn't hold, null where the snapshot may be used."""
    why = F.when(F.col("schema") != schema, "schema").when(~F.col("commit_sha").eqNullSafe(F.lit(commit_sha)), "commit").when(F.coalesce("salt_check", F.lit("")) != salt_check, "salt")
    return catalog.withColumn("refusal", why)


def soft_drift(catalog: DataFrame, now: dict[str, str]) -> DataFrame:
    """``(path, name, recorded, current)`` of soft conditions that differ, where the snapshot recorded them."""
    rows = catalog.select("path", F.explode("soft").alias("name", "recorded"))
    current = F.element_at(F.create_map(*[F.lit(x) for kv in now.items() for x in kv]), F.col("name")) if now else F.lit(None).cast("string")
    return rows.withColumn("current", current).filter(F.col("current").isNotNull() & (F.col("recorded") != F.col("current")))


def pick_released(catalog: DataFrame, conditions: DataFrame) -> DataFrame:
    """``(commit_sha, corpus_token, options_fp, path)``: for each condition the oldest matching snapshot. A snapshot
    without a recorded ``options_fp`` matches any; one without ``created_at`` is the oldest (ties: by path)."""
    c = conditions.select(F.col("commit_sha").alias("c_sha"), F.col("corpus_token").alias("c_token"), F.col("options_fp").alias("c_fp"))
    same = (F.col("commit_sha") == F.col("c_sha")) & (F.col("corpus_token") == F.col("c_token")) & (F.col("options_fp").isNull() | (F.col("options_fp") == F.col("c_fp")))
    age = F.struct(F.coalesce("created_at", F.lit("")).alias("t"), "path")
    g = catalog.join(c, same).groupBy("c_sha", "c_token", "c_fp").agg(F.min(age).alias("x"))
    return g.select(F.col("c_sha").alias("commit_sha"), F.col("c_token").alias("corpus_token"), F.col("c_fp").alias("options_fp"), F.col("x.path").alias("path"))


def cached(registry: DataFrame, live: DataFrame) -> DataFrame:
    """``(label, hit)``: the registered sha and count are still the live ones."""
    j = registry.alias("r").join(live.alias("l"), "label", "left")
    hit = F.coalesce((F.col("r.git_sha") == F.col("l.git_sha")) & (F.col("r.comment_count") == F.col("l.comment_count")), F.lit(False))
    return j.select("label", hit.alias("hit"))


def released_state(picked: DataFrame, drift: DataFrame) -> DataFrame:
    """``(version, state, warn)`` from ``picked(version, path, is_current)`` and ``drift(version, spam_flips)``: ``none``
    without a snapshot, ``current`` where it is the baseline itself, else ``compared``; a compared one warns when the
    harness alone flipped verdicts."""
    j = picked.join(drift, "version", "left")
    state = F.when(F.col("path").isNull(), "none").when(F.col("is_current"), "current").otherwise("compared")
    return j.select("version", state.alias("state"), ((state == "compared") & (F.coalesce("spam_flips", F.lit(0)) != 0)).alias("warn"))


def describes(catalog: DataFrame, sha: str) -> DataFrame:
    """``(path, ok)``: it is of commit ``sha`` and its file name carries the corpus token."""
    return catalog.select("path", (F.coalesce(F.col("commit_sha") == sha, F.lit(False)) & F.contains("path", F.coalesce("corpus_token", F.lit("\0")))).alias("ok"))


def assert_describes(manifest: dict, sha: str, name: str) -> None:
    if manifest.get("commit_sha") != sha or not manifest.get("corpus_token") or manifest["corpus_token"] not in name:
        raise GateError(f"{name} doesn't describe commit {sha}")
