"""Structured Streaming forms: incremental classification, trust by e-mail, throughput windows."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from verdictlab.functions.rules import Ruleset, classify

#: Ids of one folder of a sink.
WIDTH = 1_000_000


def _range(id_, width: int):
    return F.floor(id_.cast("long") / F.lit(width)).cast("long")


def known_ids(spark: SparkSession, sink: str, ranges: list[int]) -> DataFrame | None:
    """``(id, batch)`` of what a sink of ``classify_stream`` has in some id ranges; other folders are neither listed nor
    read. None where it has nothing."""
    conf, hadoop = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    paths = [f"{sink}/range={r}" for r in ranges]
    fs = hadoop(sink).getFileSystem(conf)
    paths = [p for p in paths if fs.exists(hadoop(p))]
    if not paths:
        return None
    return spark.read.schema("id string, range long, batch string").option("basePath", sink).parquet(*paths).select("id", "batch")


def read_sink(spark: SparkSession, sink: str) -> DataFrame:
    """``(id, status, reason)`` of a sink of ``classify_stream``."""
    return spark.read.schema("id string, status string, reason string, range long, batch string").parquet(sink).select("id", "status", "reason")


def classify_stream(stream: DataFrame, ruleset: Ruleset, sink: str, checkpoint: str, width: int = WIDTH) -> StreamingQuery:
    """Classify what is new and stop; no comment is processed twice.

    The sink has a folder for each range of ``width`` ids, and in it one for each batch. A batch anti-joins what other batches
    have in the ranges that it touches itself, so what it reads doesn't grow with the sink while ids grow; repeated ids of one
    batch are folded. A batch that was written but not committed is written again into its own folders: it neither adds
    rows nor loses any. The checkpoint's path is part of a batch's name, so another run can't overwrite it. The list of
    ranges that a batch touches goes through the driver; it is as long as its ids are spread, over ``width``.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def put(batch: DataFrame, no: int) -> None:
        label = f"{run}-{no}"
        rows = batch.dropDuplicates(["comment_id"])
        ranges = [r[0] for r in batch.select(_range(F.col("comment_id"), width).alias("r")).distinct().collect()]
        known = known_ids(batch.sparkSession, sink, ranges)
        if known is not None:
            other = known.filter(F.col("batch") != label).select("id")
            rows = rows.join(other, rows["comment_id"].cast("string") == other["id"], "left_anti")
        out = classify(rows, ruleset).withColumn("range", _range(F.col("id"), width)).withColumn("batch", F.lit(label))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("range", "batch").parquet(sink)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_heartbeats(stream: DataFrame, ts: str, late: str, order: str) -> DataFrame:
    """``stream`` with a watermark ``late`` behind the newest ``ts``. Rows without ``order`` are heartbeats: they move the
    watermark and go."""
    w = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    # one condition on the time itself, so it isn't pushed below the watermark
    return w.filter(F.when(F.col(ts).isNull(), F.lit(False)).otherwise(F.col(order).isNotNull()))


#: Groups in which state is kept, rows of a pack of it, and cells of a group's first approved ids.
BUCKETS, PACK, CELLS = 1024, 10_000, 16
#: Rows, and bytes of them, that a task gathers before it deals them into packs.
GATHER, GATHER_BYTES = 200_000, 32 << 20
#: The rows of a pack.
KEPT = pa.schema([("k", pa.string()), ("id", pa.int64()), ("ms", pa.int64()), ("spam", pa.bool_())])


def packed(rows: DataFrame) -> DataFrame:
    """``(bucket, ts, least, rows)`` of ``rows(bucket, k, id, spam, ts, ms)``: packs of up to ``PACK`` rows of one bucket as
    Arrow, with their newest ``ts`` and least ``ms``. A negative bucket holds heartbeats; their ``rows`` are null. Rows are dealt
    in the tasks that read them, up to ``GATHER`` at a time, for Spark hands a state operator its rows one by one."""
    kept, most, gather, size = KEPT, PACK, GATHER, GATHER_BYTES

    def deal(some: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(some)
        t = t.take(pc.sort_indices(t["bucket"])).combine_chunks()
        bucket, ms = t["bucket"].to_numpy(), t["ms"].to_numpy()
        micros = t["ts"].cast(pa.int64()).to_numpy()
        place = np.arange(len(bucket))
        begin = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        within = place - np.repeat(begin, np.diff(np.r_[begin, len(bucket)]))
        begin = np.flatnonzero(within % most == 0)
        body = t.select(kept.names).cast(kept).to_batches()[0]
        ends = np.r_[begin[1:], len(bucket)]
        out = [None if bucket[a] < 0 else body.slice(a, b - a).serialize().to_pybytes() for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]
        newest = pa.array(np.maximum.reduceat(micros, begin)).cast(t["ts"].type)
        return pa.RecordBatch.from_arrays([pa.array(bucket[begin]), newest, pa.array(np.minimum.reduceat(ms, begin)), pa.array(out, pa.binary())], names=["bucket", "ts", "least", "rows"])

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[pa.RecordBatch] = []
        n = held = 0
        for b in batches:
            if len(b):
                some.append(b)
                n, held = n + len(b), held + b.nbytes
            if n >= gather or held >= size:
                yield deal(some)
                some, n, held = [], 0, 0
        if some:
            yield deal(some)

    return rows.mapInArrow(pack, "bucket int, ts timestamp, least long, rows binary")


def approved_email_stream(stream: DataFrame, key: str, order: str, spam: str, ts: str, late: str, history: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """``(id, key, spam, trusted, final_spam)``: the batch rule ``approved_email`` over a stream whose files come in any
    order, as long as rows are no more than ``late`` behind.

    Rows are held as state until the watermark has passed them, for then all earlier ones are known (``order``
    rises with ``ts``); a timer lets them go. The first approved id of each key stays as state. ``history`` gives
    ``(key, first)`` from a batch (``ordered.first_approved``) to begin with. Rows without a key are held likewise
    and never trusted, as in the batch rule. Rows without ``order`` are heartbeats. Needs the RocksDB state store.

    Rows come to the state in packs (``packed``). Spark drops and counts packs of which all rows are too late; late rows of other packs are
    dropped where their bucket has let rows go up to then, so no row is judged after a later one of its key has gone.

    State is kept by buckets of the key's hash (of ``order``, where there is no key), so calls and timers are as many as ``buckets``,
    however many keys there are. A bucket's rows are held in packs of Arrow and worked through pack by pack; its first
    approved ids lie in ``CELLS`` cells by the key's checksum, and only cells of keys with rows that are let go are read. ``buckets`` must stay as it is for a
    checkpoint.
    """
    kept, pack, cells, firsts = KEPT, PACK, CELLS, pa.schema([("k", pa.string()), ("id", pa.int64())])

    def packs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The same rows in batches of about ``pack`` rows; empty ones are left out."""
        some: list[pa.RecordBatch] = []
        for b in batches:
            some += [b] if len(b) else []
            if sum(map(len, some)) >= pack:
                yield pa.concat_batches(some)
                some = []
        if some:
            yield pa.concat_batches(some)

    class Trust(StatefulProcessor):
        """Defined here, as ``packs`` is, so that it travels to the workers by value."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.first = handle.getMapState("first", "cell int", "ids binary")
            self.past = handle.getValueState("past", "ms long")
            self.wake = handle.getValueState("wake", "ms long")
            self.held = handle.getListState("held", "rows binary")

        def handleInitialState(self, key, initialState, timerValues) -> None:
            known = initialState.dropna(subset=["first"])
            least = known.groupby("k")["first"].min()
            self._approve({k: int(first) for k, first in zip(least.index, least, strict=True)})

        def _approve(self, least: dict[str, int | None]) -> dict[str, int | None]:
            """The first approved id of each key of ``least``, which may hold earlier ones."""
            by: dict[int, list[str]] = {}
            for k in least:
                by.setdefault(zlib.crc32(k.encode()) % cells, []).append(k)
            first: dict[str, int | None] = {}
            for cell, keys in by.items():
                got = self.first.getValue((cell,))
                ids = {} if got is None else dict(zip(*(c.to_pylist() for c in pa.ipc.read_record_batch(pa.py_buffer(bytes(got[0])), firsts).columns), strict=True))
                new = {k: least[k] for k in keys if least[k] is not None and (k not in ids or least[k] < ids[k])}
                if new:
                    ids |= new
                    b = pa.RecordBatch.from_arrays([pa.array(list(ids), pa.string()), pa.array(list(ids.values()), pa.int64())], schema=firsts)
                    self.first.updateValue((cell,), (b.serialize().to_pybytes(),))
                first |= {k: ids.get(k) for k in keys}
            return first

        def _wake_at(self, ms: int) -> None:
            """One timer a bucket, at the earliest row that is held."""
            now = self.wake.get()[0] if self.wake.exists() else None
            if now is None or ms < now:
                if now is not None:
                    self.handle.deleteTimer(now)
                self.handle.registerTimer(ms)
                self.wake.update((ms,))

        def _held(self) -> Iterator[pa.RecordBatch]:
            for (rows,) in self.held.get():
                yield pa.ipc.read_record_batch(pa.py_buffer(bytes(rows)), kept)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            past = self.past.get()[0] if self.past.exists() else None

            def taken() -> Iterator[pa.RecordBatch]:
                for chunk in rows:
                    for low, one in zip(chunk["least"], chunk["rows"], strict=True):
                        b = pa.ipc.read_record_batch(pa.py_buffer(bytes(one)), kept)
                        yield b if past is None or low >= past else b.filter(pc.greater_equal(b["ms"], past))

            least = []
            for b in packs(taken()):
                self.held.appendValue((b.serialize().to_pybytes(),))
                least.append(pc.min(b["ms"]).as_py())
            if least:
                self._wake_at(min(least) + 1)
            yield from ()

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            now = timerValues.getCurrentWatermarkInMs()
            more = False

            def due() -> Iterator[pa.RecordBatch]:
                nonlocal more
                for b in self._held():
                    some = b.filter(pc.less(b["ms"], now))
                    more = more or len(some) < len(b)
                    yield some

            least: dict[str | None, int | None] = {}
            for b in packs(due()):
                good = pc.if_else(pc.fill_null(pc.invert(b["spam"]), False), b["id"], pa.scalar(None, pa.int64()))
                of = pa.table({"k": b["k"], "id": good}).group_by("k").aggregate([("id", "min")])
                for k, id_ in zip(of["k"].to_pylist(), of["id_min"].to_pylist(), strict=True):
                    known = least.get(k)
                    least[k] = id_ if known is None or id_ is not None and id_ < known else known
            # a row without a key is alone, and nothing is kept of it
            least.pop(None, None)
            first = self._approve(least)
            for b in packs(due()):
                k = b["k"].dictionary_encode()
                approved = pa.array([first.get(x) for x in k.dictionary.to_pylist()], pa.int64()).take(k.indices)
                trusted = pc.fill_null(pc.less(approved, b["id"]), False)
                final = pc.and_kleene(b["spam"], pc.invert(trusted))
                yield pa.table({"id": b["id"], "k": b["k"], "spam": b["spam"], "trusted": trusted, "final_spam": final}).to_pandas(types_mapper=pd.ArrowDtype)
            rest = list(packs(b.filter(pc.greater_equal(b["ms"], now)) for b in self._held())) if more else []
            self.past.update((now,))
            self.wake.clear()
            if rest:
                self.held.put([(b.serialize().to_pybytes(),) for b in rest])
                self._wake_at(min(pc.min(b["ms"]).as_py() for b in rest) + 1)
            else:
                self.held.clear()

        def close(self) -> None:
            pass

    bucket = lambda k: F.pmod(F.xxhash64(k), F.lit(buckets)).cast("int").alias("bucket")
    at, text = F.col(ts).cast("timestamp"), F.col(key).cast("string")
    kind, id_ = stream.schema[key].dataType, F.col(order).cast("long")
    alone = F.coalesce(text, F.col(order).cast("string"))
    group = F.when(F.col(order).isNull(), -1).otherwise(bucket(alone)).alias("bucket")
    rows = stream.filter(at.isNotNull()).select(group, text.alias("k"), id_.alias("id"), F.col(spam).cast("boolean").alias("spam"), at.alias("ts"), F.unix_millis(at).alias("ms"))
    rows = with_heartbeats(packed(rows), "ts", late, "rows")
    start = None
    if history is not None:
        known = F.col("key").cast("string")
        start = history.filter("key is not null").select(bucket(known), known.alias("k"), "first").groupBy("bucket")
    out = rows.groupBy("bucket").transformWithStateInPandas(Trust(), "id long, k string, spam boolean, trusted boolean, final_spam boolean", "Append", "EventTime", start)
    return out.select("id", F.col("k").cast(kind).alias("key"), "spam", "trusted", "final_spam")


def throughput(stream: DataFrame, ts: str, width: str, late: str, order: str | None = None) -> DataFrame:
    """``(window_start, n)`` per time window, each given when the watermark has passed its end; rows later than ``late``
    behind the newest are dropped. With ``order``, rows without it are heartbeats."""
    rows = with_heartbeats(stream, ts, late, order or ts).observe(OBSERVED, F.count(F.lit(1)).alias("n"))
    g = rows.groupBy(F.window(ts, width).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("window_start"), "n")


#: The name under which ``throughput`` counts the rows that it is given.
OBSERVED = "throughput_rows"


class RowsSeen(StreamingQueryListener):
    """Counts the rows that ``throughput`` was given, query by query, over restarts; and the late ones as Spark reports
    them, which are groups of rows where it has aggregated them before."""

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}
        self.late_groups: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.add(event.progress)

    def add(self, p) -> None:
        """One progress report, of a running query or of ``recentProgress``."""
        got = p.observedMetrics.get(OBSERVED)
        if got is not None:
            self.seen[str(p.id)] = self.seen.get(str(p.id), 0) + got["n"]
        late = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        self.late_groups[str(p.id)] = self.late_groups.get(str(p.id), 0) + late
