import random
import time
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import functions as F

from verdictlab.functions import rules
from verdictlab.operators.ordered import approved_email, first_approved
from verdictlab.streaming import incremental as inc


def comments(spark, low, high):
    return spark.range(low, high).select(F.col("id").alias("comment_id"), F.concat(F.lit("mail a@b.cd "), "id").alias("content"), F.lit("").alias("type"))


def test_no_comment_twice(spark, tmp_path, rows):
    c = comments(spark, 0, 60)
    read = lambda: spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    c.filter("comment_id < 40").repartition(3).write.parquet(f"{tmp_path}/in")
    run = lambda cp="cp": inc.classify_stream(read(), rules.old_rules(), f"{tmp_path}/out", f"{tmp_path}/{cp}", width=16).awaitTermination()
    run()
    c.filter("comment_id >= 30").write.mode("append").parquet(f"{tmp_path}/in")  # some again
    run()
    run()
    want = rows(rules.classify(c, rules.old_rules()))
    assert rows(inc.read_sink(spark, f"{tmp_path}/out")) == want
    run("another")  # knows nothing of the first run but what the sink has
    assert rows(inc.read_sink(spark, f"{tmp_path}/out")) == want


def test_a_batch_that_is_replayed_adds_nothing(spark, tmp_path, rows):
    c = comments(spark, 0, 30)
    c.coalesce(1).write.parquet(f"{tmp_path}/in")
    run = lambda: inc.classify_stream(spark.readStream.schema(c.schema).parquet(f"{tmp_path}/in"), rules.old_rules(), f"{tmp_path}/out", f"{tmp_path}/cp", width=8).awaitTermination()
    run()
    before = rows(inc.read_sink(spark, f"{tmp_path}/out"))
    (tmp_path / "cp/commits/0").unlink()  # written, not committed
    (tmp_path / "cp/commits/.0.crc").unlink(missing_ok=True)
    run()
    assert rows(inc.read_sink(spark, f"{tmp_path}/out")) == before and len(before) == 30


def test_what_a_batch_reads_does_not_grow_with_the_sink(spark, tmp_path):
    schema, read = comments(spark, 0, 1).schema, []
    for i in range(20):
        comments(spark, 50 * i, 50 * i + 50).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        known = inc.known_ids(spark, f"{tmp_path}/out", [50 * i // 100])
        read.append(0 if known is None else len(known.inputFiles()))
        inc.classify_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), rules.old_rules(), f"{tmp_path}/out", f"{tmp_path}/cp", width=100).awaitTermination()
    assert inc.read_sink(spark, f"{tmp_path}/out").count() == 1000
    assert max(read[10:]) <= max(read[:4]) <= 8


START = datetime(2024, 1, 1)
EVENT = "id long, k long, s boolean, ts timestamp"


def events(n, seed=1, keys=7):
    r = random.Random(seed)
    return [(i, r.choice([None, *range(keys)]), r.random() < 0.4, START + timedelta(minutes=i)) for i in range(n)]


def run_trust(spark, tmp_path, late, out="out", history=None, **how):
    stream = spark.readStream.schema(EVENT).options(**how).parquet(f"{tmp_path}/in")
    o = inc.approved_email_stream(stream, "k", "id", "s", "ts", late, history)
    q = o.writeStream.format("parquet").option("path", f"{tmp_path}/{out}").option("checkpointLocation", f"{tmp_path}/cp-{out}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("id long, key long, spam boolean, trusted boolean, final_spam boolean").parquet(f"{tmp_path}/{out}")


def put(spark, tmp_path, data):
    spark.createDataFrame(data, EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    time.sleep(0.05)  # files are read by age


def test_trust_by_state_equals_batch_with_files_in_any_order(spark, tmp_path, rows):
    data = events(120)
    mixed = random.Random(4).sample(data, len(data))
    for i in range(4):
        put(spark, tmp_path, mixed[i * 30 : i * 30 + 30])
    assert run_trust(spark, tmp_path, "3 hours", maxFilesPerTrigger=1).count() < 120  # what isn't passed by the watermark is held
    put(spark, tmp_path, [(None, None, None, START + timedelta(days=9))])
    got = run_trust(spark, tmp_path, "3 hours", maxFilesPerTrigger=1)
    want = approved_email(spark.createDataFrame(data, EVENT), "k", "id", "s").select("id", "k", "s", "trusted", "final_spam")
    assert rows(got.select("id", "key", "spam", "trusted", "final_spam")) == rows(want)


def test_trust_goes_on_from_a_batch(spark, tmp_path, rows):
    data = events(80, seed=3)
    old, new = spark.createDataFrame(data[:40], EVENT), data[40:]
    put(spark, tmp_path, new[20:])
    put(spark, tmp_path, [*new[:20], (None, None, None, START + timedelta(days=9))])
    got = run_trust(spark, tmp_path, "2 hours", history=first_approved(old, "k", "id", "s").filter("first is not null"))
    want = approved_email(spark.createDataFrame(data, EVENT), "k", "id", "s").filter("id >= 40").select("id", "k", "s", "trusted", "final_spam")
    assert rows(got.select("id", "key", "spam", "trusted", "final_spam")) == rows(want)


def test_state_of_trust_grows_with_buckets_not_with_keys(spark, tmp_path):
    n = 12_000  # every second row has no key, all others have one of their own
    k = F.when(F.col("id") % 2 == 0, F.col("id"))
    data = spark.range(n).select("id", k.alias("k"), (F.col("id") % 3 == 0).alias("s"), (F.lit(START) + F.make_dt_interval(mins=F.col("id") % 60)).alias("ts"))
    data.repartition(2).write.parquet(f"{tmp_path}/in")
    out = inc.approved_email_stream(spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in"), "k", "id", "s", "ts", "9 days")
    q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp-out").trigger(availableNow=True).start()
    q.awaitTermination()
    assert max(p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators) <= 5 * 1024
    put(spark, tmp_path, [(None, None, None, START + timedelta(days=30))])
    assert run_trust(spark, tmp_path, "9 days").filter("not trusted").count() == n


def test_rows_reach_the_state_in_packs(spark, monkeypatch):
    monkeypatch.setattr(inc, "PACK", 500)
    n, buckets = 30_000, 8
    bucket = F.when(F.col("id") % 1000 == 7, -1).when(F.col("id") % 2 == 0, 3).otherwise(F.col("id") % buckets).cast("int")
    ts = F.lit(START).cast("timestamp") + F.make_dt_interval(mins=F.col("id") % 60)
    data = spark.range(n).repartition(2).select(bucket.alias("bucket"), F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("k"), "id", (F.col("id") % 3 == 0).alias("spam"), ts.alias("ts"), F.unix_millis(ts).alias("ms"))
    got = inc.packed(data).collect()
    assert len(got) <= 2 * (buckets + 1) + n // 500
    found = []
    for p in got:
        if p["bucket"] < 0:
            assert p["rows"] is None
            continue
        b = pa.ipc.read_record_batch(pa.py_buffer(bytes(p["rows"])), inc.KEPT).to_pylist()
        assert len(b) <= 500 and p["least"] == min(r["ms"] for r in b) and p["ts"].timestamp() * 1000 == max(r["ms"] for r in b)
        found += [(p["bucket"], r["k"], r["id"], r["spam"], r["ms"]) for r in b]
    want = [tuple(r) for r in data.filter("bucket >= 0").select("bucket", "k", "id", "spam", "ms").collect()]
    key = lambda r: r[2]
    assert sorted(found, key=key) == sorted(want, key=key)


def test_a_late_row_in_a_file_with_new_ones_is_dropped(spark, tmp_path):
    at = lambda i, hours, s=False: (i, 1, s, START + timedelta(hours=hours))
    put(spark, tmp_path, [at(10, 1), at(11, 20)])
    run_trust(spark, tmp_path, "2 hours")  # lets go up to hour 18
    put(spark, tmp_path, [at(5, 0.5), at(12, 19, True), at(13, 21)])
    put(spark, tmp_path, [(None, None, None, START + timedelta(days=9))])
    got = run_trust(spark, tmp_path, "2 hours")
    assert {r["id"]: r["trusted"] for r in got.collect()} == {10: False, 11: True, 12: True, 13: True}


def test_trust_with_unknown_spam_equals_batch(spark, tmp_path, rows):
    data = [(i, k, None if i % 4 == 0 else s, ts) for i, k, s, ts in events(60, seed=5, keys=3)]
    put(spark, tmp_path, data)
    put(spark, tmp_path, [(None, None, None, START + timedelta(days=9))])
    got = run_trust(spark, tmp_path, "2 hours")
    want = approved_email(spark.createDataFrame(data, EVENT), "k", "id", "s").select("id", "k", "s", "trusted", "final_spam")
    assert rows(got.select("id", "key", "spam", "trusted", "final_spam")) == rows(want)


def test_windows_drop_late_rows_and_the_rest_is_counted(spark, tmp_path):
    seen = inc.RowsSeen()
    spark.streams.addListener(seen)
    try:
        at = lambda *hours: [(i, 1, False, START + timedelta(hours=h)) for i, h in enumerate(hours)]
        for data in (at(0.01, 0.9, 5), at(0.2, 0.3, 9), at(8, 8.5, 4.9), [(None, None, None, START + timedelta(days=9))]):
            put(spark, tmp_path, data)
            stream = spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in")
            q = inc.throughput(stream, "ts", "1 hour", "2 hours", "id").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
            q.awaitTermination()
            query = str(q.id)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(seen)
    got = {r[0].hour: r[1] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {0: 2, 5: 1, 8: 2, 9: 1}
    assert seen.seen[query] - sum(got.values()) == 3 and 0 < seen.late_groups[query] <= 3
