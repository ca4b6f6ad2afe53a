from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from verdictlab.functions import rules
from verdictlab.functions.scalars import salt_check
from verdictlab.functions.shared import shared_dir
from verdictlab.operators.aggregates import counted_run, run_counters
from verdictlab.operators.gates import GateError
from verdictlab.operators.joins import diff
from verdictlab.sources import catalog as cat, corpus as src, passes, snapshot as snap

V = "id string, status string, reason string"
DATA = [("3", "spam", "a,b"), ("1", "1", None), ("2", "sp\tam", ""), ("4", "1", "50% + ~*|\n")]


def test_snapshot_round_trip(spark, tmp_path, rows):
    df = spark.createDataFrame(DATA, V).repartition(3)
    m = snap.write_snapshot(df, f"{tmp_path}/s", {"salt_check": "x", "shard_mode": "email", "soft": {"workers": "4"}})
    got, back = snap.read_snapshot(spark, f"{tmp_path}/s")
    assert rows(back) == rows(df) and got["digest"] == m["digest"] and got["publishable"] and got["soft"] == {"workers": "4"}
    assert snap.read_manifest(spark, f"{tmp_path}/s").first()["rows"] == 4
    snap.write_text(df, f"{tmp_path}/t", {"ref": "r"})
    meta, back = snap.read_text(spark, f"{tmp_path}/t")
    assert rows(back) == rows(df) and meta["ref"] == "r"


def test_digest_tells_null_from_empty_but_not_order(spark):
    df = spark.createDataFrame(DATA, V)
    digest = lambda x: snap.content_digest(x).first()[0]
    assert digest(df) == digest(df.orderBy(F.desc("id")).repartition(5))
    assert digest(df) != digest(df.withColumn("reason", F.coalesce("reason", F.lit(""))))


def test_broken_snapshots_are_refused(spark, tmp_path):
    df = spark.createDataFrame(DATA, V)
    snap.write_snapshot(df, f"{tmp_path}/s", {})
    df.limit(3).write.mode("overwrite").parquet(f"{tmp_path}/s/verdicts")
    with pytest.raises(ValueError, match="manifest"):
        snap.read_snapshot(spark, f"{tmp_path}/s")
    df.withColumn("status", F.lit("1")).write.mode("overwrite").parquet(f"{tmp_path}/s/verdicts")
    with pytest.raises(ValueError):
        snap.read_snapshot(spark, f"{tmp_path}/s")
    snap.write_snapshot(df, f"{tmp_path}/u", {})
    snap.file_digests(spark.read.parquet(f"{tmp_path}/u/verdicts")).withColumn("s", F.col("s") + 1).write.mode("overwrite").parquet(f"{tmp_path}/u/files")
    with pytest.raises(ValueError, match="list of files"):
        snap.read_snapshot(spark, f"{tmp_path}/u")
    snap.write_snapshot(df.limit(0), f"{tmp_path}/e", {})
    assert snap.read_snapshot(spark, f"{tmp_path}/e")[1].count() == 0
    snap.write_text(df, f"{tmp_path}/t", {})
    spark.createDataFrame([("a\tb",)], "value string").write.mode("append").text(f"{tmp_path}/t/body", compression="gzip")
    with pytest.raises(ValueError, match="three fields"):
        snap.read_text(spark, f"{tmp_path}/t")


def test_export_guards(spark, tmp_path):
    df = spark.createDataFrame(DATA, V)
    m = snap.export_snapshot(df, "salt", {"shard_mode": "mod"}, f"{tmp_path}/s")
    assert m["salt_check"] == salt_check("salt") and not m["publishable"]
    with pytest.raises(GateError):
        snap.export_snapshot(df.filter("false"), "salt", {}, f"{tmp_path}/e")
    with pytest.raises(GateError):
        snap.export_snapshot(df.unionByName(df), "salt", {}, f"{tmp_path}/d")


def test_sample_skips_bad_lines(spark, tmp_path):
    lines = ["1\t1\tcomment\t\taGk=\t\t", "", "short\tline", "2\t0\tpingback\tcss\t@@@\tdQ==\t"]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(f"{tmp_path}/x")
    got = {r["comment_id"]: r for r in src.read_sample_tsv(spark, f"{tmp_path}/x").collect()}
    assert set(got) == {1, 2} and got[1]["content"] == "hi" and got[1]["is_ham"] and got[2]["content"] == "" and got[2]["author_url"] == "u"


def test_sample_round_trip(spark, tmp_path):
    text = "tab\there\nand 漢字 " * 20
    df = spark.createDataFrame([(1, True, "comment", None, text, "u", None)], "comment_id long, is_ham boolean, type string, reason string, content string, author_url string, agent string")
    src.write_sample_tsv(df, f"{tmp_path}/x")
    assert src.read_sample_tsv(spark, f"{tmp_path}/x").first()["content"] == text


def test_labels_replace_and_registry_keeps_the_last(spark, tmp_path, rows):
    df = spark.createDataFrame(DATA, V)
    src.save_labelled(df, f"{tmp_path}/l", "a")
    src.save_labelled(df.limit(1), f"{tmp_path}/l", "b")
    src.save_labelled(df.limit(2), f"{tmp_path}/l", "a")
    assert rows(spark.read.parquet(f"{tmp_path}/l").groupBy("label").count()) == [("a", 2), ("b", 1)]
    p = spark.createDataFrame([("a", "s1", 1, "2024-01-01"), ("a", "s2", 2, "2024-02-01"), ("b", "s3", 3, "2024-01-01")], "label string, git_sha string, comment_count int, created_at string")
    assert rows(src.register_pass(p.limit(1), p).select("label", "git_sha")) == [("a", "s2"), ("b", "s3")]


def test_catalogue(spark, rows):
    c = spark.createDataFrame(
        [("p1", 2, "c", "t", None, "2024-02-02", {"w": "4"}, "k"), ("p2", 2, "c", "t", "o", "2024-01-01", {"w": "6"}, "k"), ("p3", 2, "c", "t", "x", "2023-01-01", {}, ""), ("p4", 1, "c", "t", "o", None, {"w": "4"}, "k")],
        "path string, schema int, commit_sha string, corpus_token string, options_fp string, created_at string, soft map<string,string>, salt_check string",
    )
    ask = spark.createDataFrame([("c", "t", "o"), ("c", "t", "z"), ("d", "t", "o")], "commit_sha string, corpus_token string, options_fp string")
    assert rows(cat.pick_released(c, ask)) == [("c", "t", "o", "p4"), ("c", "t", "z", "p1")]
    assert rows(cat.usable(c, 2, "c", "k").select("path", "refusal")) == [("p1", None), ("p2", None), ("p3", "salt"), ("p4", "schema")]
    assert rows(cat.soft_drift(c, {"w": "4", "other": "1"})) == [("p2", "w", "6", "4")]
    assert cat.soft_drift(c, {}).count() == 0
    cat.assert_describes({"commit_sha": "c", "corpus_token": "tok"}, "c", "snap-tok.gz")
    with pytest.raises(GateError):
        cat.assert_describes({"commit_sha": "c", "corpus_token": "tok"}, "c", "snap.gz")


def test_corpus_over_jdbc(spark):
    """Partitioned by id, unsigned ids (a decimal there) as longs, and only the corpus columns."""
    url = "jdbc:derby:memory:corpus;create=true"
    cols = "comment_id decimal(20,0), content string, author string, author_email string, author_url string, author_ip string, agent string, type string, other string"
    rows = [(i, f"text {i}", "a", "e@x", "", "1.2.3.4", "", "comment", "x") for i in range(1, 41)]
    spark.createDataFrame([(Decimal(r[0]), *r[1:]) for r in rows], cols).write.format("jdbc").options(url=url, dbtable="comments", driver="org.apache.derby.jdbc.EmbeddedDriver").save()
    got = src.read_corpus(spark, {"url": url, "dbtable": "comments", "driver": "org.apache.derby.jdbc.EmbeddedDriver", "lower": 1, "upper": 41}, partitions=4)
    assert got.rdd.getNumPartitions() == 4 and dict(got.dtypes)["comment_id"] == "bigint"
    assert sorted(tuple(r) for r in got.collect()) == [r[:8] for r in rows]


def test_shared_folder_on_a_cluster():
    """Only a local session gets a folder of its own; elsewhere the setting is asked for."""

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())


def many(spark, n=4000):
    return spark.range(n).select((F.col("id") * 7919 % 100_003).cast("string").alias("id"), F.when(F.col("id") % 3 == 0, "spam").otherwise("1").alias("status"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("r"), F.col("id") % 4)).alias("reason"))


@pytest.fixture
def wide(spark):
    """Range partitions as they would be of much data."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_a_damaged_file_is_named(spark, tmp_path, wide):
    path = f"{tmp_path}/s"
    m = snap.write_snapshot(many(spark), path, {})
    assert m["digest"] == snap.content_digest(many(spark)).first()[0] == snap.folded_digest(snap.read_files(spark, path)).first()[0]
    files = sorted(r["file"] for r in snap.read_files(spark, path).filter("rows > 0").collect())
    assert len(files) == 4
    one = spark.read.parquet(f"{path}/verdicts/{files[2]}").withColumn("reason", F.when(F.col("reason") != "r3", F.col("reason")))
    one.coalesce(1).write.parquet(f"{tmp_path}/new")
    (tmp_path / f"s/verdicts/.{files[2]}.crc").unlink()
    next((tmp_path / "new").glob("part-*")).rename(tmp_path / f"s/verdicts/{files[2]}")
    with pytest.raises(ValueError, match=files[2]):
        snap.read_snapshot(spark, path)
    with pytest.raises(ValueError, match=files[2]):
        snap.read_snapshot(spark, path, only=files[2:])
    assert snap.read_snapshot(spark, path, only=files[:2])[1].count() == snap.read_files(spark, path).filter(F.col("file").isin(files[:2])).agg(F.sum("rows")).first()[0]


def test_files_have_ranges_and_one_is_read_for_one_id(spark, tmp_path, wide, rows):
    path, df = f"{tmp_path}/s", many(spark)
    snap.write_snapshot(df, path, {})
    got = snap.bytewise(snap.read_files(spark, path)).first()
    ids = sorted(r["id"] for r in df.select("id").collect())
    assert (got["files"], got["rows"], got["least"], got["greatest"], got["rising"]) == (4, 4000, ids[0], ids[-1], True)
    for i in (ids[0], ids[1234], ids[-1]):
        found = snap.lookup(spark, path, [i])
        assert len(found.inputFiles()) == 1 and rows(found) == rows(df.filter(F.col("id") == i))
    assert snap.lookup(spark, path, ["zzz"]).count() == 0 and snap.lookup(spark, path, []).count() == 0
    assert rows(snap.lookup(spark, path, [ids[3], ids[3999]])) == rows(df.filter(F.col("id").isin(ids[3], ids[3999])))
    both = snap.read_files(spark, path).unionByName(snap.read_files(spark, path))
    assert not snap.bytewise(both).first()["rising"]


def test_snapshots_in_buckets_are_compared_without_a_shuffle(spark, tmp_path, rows):
    old, new = many(spark), many(spark).filter("id not like '1%'").withColumn("status", F.lit("1")).unionByName(spark.createDataFrame([("zz", "1", None)], V))
    for name, df in (("old", old), ("new", new)):
        snap.write_snapshot(df, f"{tmp_path}/{name}", {}, buckets=6)
        assert rows(snap.read_snapshot(spark, f"{tmp_path}/{name}")[1]) == rows(df)
    d = snap.diff_snapshots(spark, f"{tmp_path}/old", f"{tmp_path}/new")
    assert rows(d.select("id", "old.*", F.col("new.status").alias("s"), F.col("new.reason").alias("r"))) == rows(diff(old, new).select("id", "old.*", F.col("new.status").alias("s"), F.col("new.reason").alias("r")))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "FullOuter" in plan and "Exchange" not in plan
    with pytest.raises(ValueError, match="buckets"):
        snap.write_snapshot(old, f"{tmp_path}/plain", {})
        snap.read_bucketed(spark, f"{tmp_path}/plain")


def a_pass(spark, *rows):
    return spark.createDataFrame([(label, sha, n, datetime(2024, 1, day)) for label, sha, n, day in rows], "label string, git_sha string, comment_count int, created_at timestamp_ntz")


def test_writers_side_by_side_lose_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/passes"
    assert passes.read_passes(spark, path).count() == 0
    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(lambda i: passes.upsert_passes(spark, path, a_pass(spark, (f"l{i}", "x", i, 1), ("all", f"s{i}", i, i + 1))), range(6)))
    assert sorted(versions) == [1, 2, 3, 4, 5, 6]
    got = {r["label"]: (r["git_sha"], r["comment_count"]) for r in passes.read_passes(spark, path).collect()}
    assert got == {"all": ("s5", 5)} | {f"l{i}": ("x", i) for i in range(6)}
    assert passes.read_passes(spark, path, 1).count() == 2


def test_a_writer_that_dies_leaves_the_registry_as_it_was(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/passes"
    passes.upsert_passes(spark, path, a_pass(spark, ("a", "x", 1, 1)))
    with monkeypatch.context() as m:
        m.setattr(passes, "_claim", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            passes.upsert_passes(spark, path, a_pass(spark, ("a", "y", 2, 2)))
    assert [r["git_sha"] for r in passes.read_passes(spark, path).collect()] == ["x"]
    assert passes.upsert_passes(spark, path, a_pass(spark, ("a", "z", 3, 3))) == 2
    assert [r["git_sha"] for r in passes.read_passes(spark, path).collect()] == ["z"]


def test_counts_of_a_run_are_those_of_the_join(spark, tmp_path):
    c = spark.createDataFrame([(i, "" if i % 7 == 0 else f"mail a{i}@b.cd" if i % 2 else "hello", "") for i in range(200)], "comment_id long, content string, type string").repartition(5)
    got = counted_run(c, lambda x: rules.classify(x, rules.new_rules()), lambda v: v.write.parquet(f"{tmp_path}/v"))
    want = run_counters(c, spark.read.parquet(f"{tmp_path}/v")).first()
    assert (got["seen"], got["processed"], got["skipped"]) == (want["seen"], want["processed"], want["skipped"]) and got["skipped"] == 29
    assert got["spam"] == spark.read.parquet(f"{tmp_path}/v").filter("status = 'spam'").count()
