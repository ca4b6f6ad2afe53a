"""Verdict snapshots: pseudonymous verdicts as Parquet with a manifest beside them, and a plain-text layout."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from verdictlab.functions.scalars import percent_decode, percent_encode, pseudonym, salt_check
from verdictlab.functions.shared import materialise
from verdictlab.operators.aggregates import content_digest, digest_parts, folded_digest
from verdictlab.operators.gates import assert_nonempty, assert_unique, publishable
from verdictlab.operators.joins import diff

SCHEMA = 2
MAGIC = "verdict-snapshot"
MANIFEST = (
    "schema int, rows long, digest string, publishable boolean, created_at string, salt_check string, ref string,"
    " commit_sha string, hard_fp string, corpus_token string, shard_mode string, options_fp string, soft map<string,string>, buckets int"
)


def export_verdicts(verdicts: DataFrame, salt: str) -> DataFrame:
    """``(id, status, reason)`` under pseudonyms."""
    return verdicts.select(pseudonym(F.col("id"), salt).alias("id"), "status", "reason")


def export_snapshot(verdicts: DataFrame, salt: str, meta: dict, path: str) -> dict:
    """Pseudonyms, then the guards (some rows, no two of one pseudonym), then the snapshot."""
    v = materialise(export_verdicts(verdicts, salt))
    assert_nonempty(v, "snapshot")
    assert_unique(v, "id")
    return write_snapshot(v, path, meta | {"salt_check": salt_check(salt)})


def write_snapshot(df: DataFrame, path: str, meta: dict, buckets: int | None = None) -> dict:
    """Verdicts, what each of their files holds, and the manifest, in three folders.

    Verdicts are sorted by id within range partitions, so a file has a range of ids of its own, bytewise. With
    ``buckets`` they are dealt by a hash of the id instead, each bucket sorted, and two such snapshots are compared
    without a shuffle (``diff_snapshots``).
    """
    spark = df.sparkSession
    df = df.select("id", "status", "reason")
    if buckets:
        name = _table_name(path)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        dealt = df.repartition(buckets, "id").write.mode("overwrite").option("path", f"{path}/verdicts")
        dealt.bucketBy(buckets, "id").sortBy("id").saveAsTable(name)
        spark.sql(f"DROP TABLE {name}")  # the files stay
    else:
        df.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/verdicts")
    digests = file_digests(spark.read.parquet(f"{path}/verdicts"))
    digests.write.mode("overwrite").parquet(f"{path}/files")
    files = read_files(spark, path)
    whole = files.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    manifest = {"schema": SCHEMA, "rows": whole, "digest": folded_digest(files).first()[0], "buckets": buckets} | meta
    manifest["publishable"] = publishable(manifest)
    known = {f.name for f in spark.createDataFrame([], MANIFEST).schema}
    row = {k: v for k, v in manifest.items() if k in known}
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def file_digests(verdicts: DataFrame) -> DataFrame:
    """``(file, rows, s, x, low, high)`` for each file that is read: the parts of its digest, its least and greatest id."""
    named = verdicts.select("id", "status", "reason", F.col("_metadata.file_name").alias("file"))
    return digest_parts(named, "file", F.min("id").alias("low"), F.max("id").alias("high"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("file string, rows long, s decimal(38,0), x long, low string, high string").parquet(f"{path}/files")


def bytewise(files: DataFrame) -> DataFrame:
    """``(files, rows, least, greatest, rising)``: whether the ranges of the files are disjoint, so that their order is that of
    all ids. One row for each file goes through one task."""
    before = F.max("high").over(Window.orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1))
    f = files.filter("rows > 0").withColumn("apart", F.coalesce(F.col("low") > before, F.lit(True)))
    return f.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.min("low").alias("least"), F.max("high").alias("greatest"), F.coalesce(F.bool_and("apart"), F.lit(True)).alias("rising"))


def lookup(spark: SparkSession, path: str, ids: list[str]) -> DataFrame:
    """The verdicts of some ids; only files whose range holds one of them are read."""
    inside = [(F.col("low") <= i) & (F.col("high") >= i) for i in ids]
    some = files = read_files(spark, path)
    if inside:
        some = files.filter(reduce(lambda a, b: a | b, inside))
    paths = [f"{path}/verdicts/{r['file']}" for r in some.select("file").collect()] if inside else []
    verdicts = spark.read.schema("id string, status string, reason string")
    df = verdicts.parquet(*paths) if paths else verdicts.parquet(f"{path}/verdicts").filter("false")
    return df.filter(F.col("id").isin(ids))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest row alone; the verdicts aren't read."""
    return spark.read.schema(MANIFEST).json(f"{path}/manifest")


def read_snapshot(spark: SparkSession, path: str, check: bool = True, only: list[str] | None = None) -> tuple[dict, DataFrame]:
    """Manifest and verdicts; raises where the schema isn't the manifest's, or where rows and digest of a file aren't those
    that were recorded for it (the files are named). With ``only``, some files are read, and just those are checked."""
    got = read_manifest(spark, path).head(2)
    if len(got) != 1:
        raise ValueError(f"{path}: one manifest expected, {len(got)} found")
    manifest = got[0].asDict()
    if manifest["schema"] != SCHEMA:
        raise ValueError(f"{path}: schema {manifest['schema']}, not {SCHEMA}")
    df = spark.read.parquet(*[f"{path}/verdicts/{f}" for f in only] if only else [f"{path}/verdicts"])
    if df.columns != ["id", "status", "reason"]:
        raise ValueError(f"{path}: columns {df.columns}")
    if check:
        files = read_files(spark, path)
        if folded_digest(files).first()[0] != manifest["digest"]:
            raise ValueError(f"{path}: the list of files isn't that of the manifest")
        files = files.filter(F.col("file").isin(only)) if only else files
        found = file_digests(df)
        same = files.join(found.select("file", *[F.col(c).alias(f"found_{c}") for c in ("rows", "s", "x")]), "file", "full_outer")
        equal = F.lit(True)
        for c in ("rows", "s", "x"):
            equal &= F.col(c).eqNullSafe(F.col(f"found_{c}"))
        # a file of no rows isn't among those that are read
        bad = same.filter(~equal & ((F.coalesce("rows", F.lit(1)) > 0) | F.col("found_rows").isNotNull()))
        bad = [r["file"] for r in bad.select("file").orderBy("file").take(5)]
        if bad:
            raise ValueError(f"{path}: the files {', '.join(bad)} don't hold what the manifest describes")
    return manifest, df


def _table_name(path: str) -> str:
    return "verdict_snapshot_" + hashlib.sha256(path.encode()).hexdigest()[:16]


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """The verdicts of a snapshot in buckets, as a table whose layout Spark knows."""
    buckets = read_manifest(spark, path).first()["buckets"]
    if not buckets:
        raise ValueError(f"{path}: not in buckets")
    name = _table_name(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} (id STRING, status STRING, reason STRING) USING parquet CLUSTERED BY (id) SORTED BY (id) INTO {buckets} BUCKETS LOCATION '{path}/verdicts'")
    return spark.table(name)


def diff_snapshots(spark: SparkSession, old: str, new: str) -> DataFrame:
    """``joins.diff`` of two snapshots in as many buckets: equal ids lie in equal buckets, so neither side is shuffled."""
    return diff(read_bucketed(spark, old), read_bucketed(spark, new))


def write_text(df: DataFrame, path: str, meta: dict) -> None:
    """The plain layout: id, status and reason, percent-encoded, by tabs, gzipped; ``#`` lines hold the manifest."""
    spark = df.sparkSession
    df = materialise(df.select("id", "status", "reason"))
    head = {"schema": SCHEMA, "rows": df.count(), "digest": content_digest(df).first()[0]} | meta
    lines = [(f"#{MAGIC} {SCHEMA}",), (f"#meta {json.dumps(head, sort_keys=True)}",)]
    body = df.repartitionByRange("id").sortWithinPartitions("id")
    body.select(F.concat_ws("\t", "id", percent_encode(F.col("status")), percent_encode(F.col("reason"))).alias("value")).write.mode("overwrite").text(f"{path}/body", compression="gzip")
    spark.createDataFrame(lines, "value string").coalesce(1).write.mode("overwrite").text(f"{path}/head", compression="gzip")


def read_text(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """The plain layout back, checked as ``read_snapshot`` does; each line must have three fields."""
    head = [r[0] for r in spark.read.text(f"{path}/head").head(3)]
    if not any(x.startswith(f"#{MAGIC} {SCHEMA}") for x in head):
        raise ValueError(f"{path}: not a snapshot of schema {SCHEMA}")
    meta = json.loads(next(x for x in head if x.startswith("#meta "))[6:])
    f = F.split("value", "\t", -1)
    rows = spark.read.text(f"{path}/body").filter(~F.col("value").startswith("#"))
    bad = rows.filter(F.size(f) != 3).count()
    if bad:
        raise ValueError(f"{path}: {bad} lines don't have three fields")
    df = rows.select(F.get(f, F.lit(0)).alias("id"), percent_decode(F.get(f, F.lit(1))).alias("status"), percent_decode(F.get(f, F.lit(2))).alias("reason"))
    if df.count() != meta["rows"] or content_digest(df).first()[0] != meta["digest"]:
        raise ValueError(f"{path}: the body isn't what the manifest describes")
    return meta, df
