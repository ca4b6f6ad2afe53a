"""Joins and set operations over corpus, meta and verdict tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from verdictlab.functions.scalars import pseudonym, version_key
from verdictlab.operators.offsets import with_last_before


def one_per_id(df: DataFrame, id_: str = "comment_id", order: str = "meta_id") -> DataFrame:
    """One row per id after a fan-out: the one of the lowest ``order``. An aggregate, so a hot id is folded before
    the shuffle."""
    rest = [c for c in df.columns if c not in (id_, order)]
    best = df.groupBy(id_).agg(F.min_by(F.struct(order, *rest), F.col(order)).alias("__r"))
    return best.select(id_, "__r.*").select(*df.columns)


def with_meta(df: DataFrame, meta: DataFrame, key: str, as_: str, id_: str = "comment_id") -> DataFrame:
    """Left join to one meta key; the filter on the key is in front of the join, so it reaches the scan."""
    own = meta.filter(F.col("meta_key") == key).select(id_, "meta_id", F.col("meta_value").alias(as_))
    return df.join(one_per_id(own, id_).drop("meta_id"), id_, "left")


def link_original(df: DataFrame, meta: DataFrame, key: str = "original_id", id_: str = "comment_id") -> DataFrame:
    """Replay rows with the id of the comment that they replay (inner: rows without one go)."""
    own = meta.filter(F.col("meta_key") == key).select(id_, F.col("meta_value").alias("original"))
    return df.join(own, id_)


def load_verdicts(comments: DataFrame, meta: DataFrame) -> DataFrame:
    """``(id, status, reason)`` of one side's replay tables, by original id."""
    rows = with_meta(link_original(comments, meta), meta, "reason", "reason")
    return rows.select(F.col("original").alias("id"), "status", "reason")


def shard_slice(df: DataFrame, shards: DataFrame, k: int, id_: str = "comment_id") -> DataFrame:
    return df.join(shards.filter(F.col("shard") == k).select(id_), id_)


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(id, old struct, new struct)``, either null where the id is on one side only. One full outer join on the id,
    so each side is shuffled once."""
    side = lambda v: v.select("id", F.struct("status", "reason").alias("v"))
    o, n = side(old).withColumnRenamed("v", "old"), side(new).withColumnRenamed("v", "new")
    return o.join(n, "id", "full_outer")


def compared(d: DataFrame) -> DataFrame:
    """The ids on both sides, flat."""
    d = d.filter("old is not null and new is not null")
    return d.select("id", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("old", "new") for c in ("status", "reason")])


def only_in(a: DataFrame, b: DataFrame, id_: str = "id") -> DataFrame:
    return a.select(id_).join(b.select(id_), id_, "left_anti")


def pending(corpus: DataFrame, done: DataFrame, id_: str = "comment_id") -> DataFrame:
    """What a run that was broken off has still to do."""
    return corpus.join(done.select(id_), id_, "left_anti")


def keep(df: DataFrame, chosen: DataFrame, id_: str = "comment_id") -> DataFrame:
    return df.join(chosen.select(id_), id_, "left_semi")


def label_flips(flips: DataFrame, origins: DataFrame, salt: str = "", default: str = "unflagged") -> DataFrame:
    """Flips with the historical label of their comment (``origin``; null where the comment isn't in ``origins``).

    Ids of ``flips`` may be pseudonyms under ``salt``. The labels are first cut down to the ids that flipped; flips are
    few, but Spark decides by size whether it may broadcast them."""
    own = origins.select(pseudonym(F.col("comment_id"), salt).alias("id"), F.col("reason").alias("__r"))
    own = own.join(flips.select("id").distinct(), "id", "left_semi")
    label = F.coalesce(F.nullif(F.col("__r"), F.lit("")), F.lit(default))
    own = own.groupBy("id").agg(F.min(label).alias("origin"))
    return flips.join(own, "id", "left")


def with_snapshot_reason(df: DataFrame, snapshot: DataFrame, salt: str = "", id_: str = "comment_id") -> DataFrame:
    """``df`` with the reason that a snapshot has for it: ``(unclassified)`` without a row, ``(none)`` for a null."""
    s = snapshot.select(F.col("id").alias("__pid"), F.coalesce("reason", F.lit("(none)")).alias("snapshot_reason"))
    d = df.join(s, pseudonym(F.col(id_), salt) == F.col("__pid"), "left").drop("__pid")
    return d.withColumn("snapshot_reason", F.coalesce("snapshot_reason", F.lit("(unclassified)")))


def common_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").intersect(b.select("id"))


def missing_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").exceptAll(b.select("id"))


def baseline_for(prepared: DataFrame, tags: DataFrame, partitions: int | None = None) -> DataFrame:
    """``(version, baseline)``: for a prerelease the highest lower prerelease of the same core, else the highest lower
    stable version; for a stable one the highest lower stable version. Null where there is none.

    All versions are sorted once, in ranges side by side, and the last stable and the last prerelease tag before each are
    carried forward: no pairs are made, and no task has all versions. The last prerelease counts where its core is the
    version's own, for then it is the highest of that core."""
    core = lambda k: F.struct(*[k[c] for c in ("major", "minor", "patch")])
    t = tags.select(F.col("version").alias("tag"), version_key(F.col("version")).alias("k")).filter("k is not null").dropDuplicates(["k"])
    p = prepared.select("version", version_key(F.col("version")).alias("k")).filter("k is not null")
    # equal versions: the tag itself isn't lower, so it comes after
    rows = p.select("version", F.lit(None).cast("string").alias("tag"), "k", F.lit(0).alias("is_tag")).unionByName(t.select(F.lit(None).cast("string").alias("version"), "tag", "k", F.lit(1).alias("is_tag")))
    k = F.col("k")
    last = with_last_before(rows, ["k", "is_tag"], {"stable": F.when(k["stable"], F.col("tag")), "pre": F.when(~k["stable"] & F.col("tag").isNotNull(), F.struct(core(k).alias("core"), "tag"))}, partitions)
    pre = F.when(F.col("pre")["core"] == core(k), F.col("pre")["tag"])
    found = last.select("version", F.when(k["stable"], F.col("stable")).otherwise(F.coalesce(pre, "stable")).alias("baseline"))
    return found.filter("version is not null")
