"""Sharding by vector bin packing: bytes, tokens and rows are balanced together, groups of equal texts stay together."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from verdictlab.functions.shared import materialise
from verdictlab.llm.mixing import word_count

#: Units placed: at most so many bundles of small groups, and about as many large groups or pieces of them.
BUNDLES = 4096
#: Groups are kept whole while the bytes of the shards differ by no more than this part of a shard.
TOLERANCE = 0.01
#: Rows numbered by one task when slots are given out.
SLOT_ROWS = 50_000


def pack(loads: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unit. Units go in falling order of their largest share of a capacity; each to the shard whose
    residual capacity has the highest dot product with it (ties: the emptiest in bytes, then the lowest number)."""
    total = loads.sum(0)
    share = loads / np.where(total > 0, total, 1) * shards
    left = np.ones((shards, loads.shape[1]))
    out = np.zeros(len(loads), np.int32)
    for i in np.lexsort((np.arange(len(loads)), -share.max(1))):
        s = share[i]
        fits = (left >= s - 1e-12).all(1)
        score = left @ s
        # a shard that has no room in some dimension comes after all that have
        best = int(np.lexsort((np.arange(shards), -left[:, 0], -score, ~fits))[0]) if s.any() else 0
        out[i] = best
        left[best] -= s
    return _even(loads, out, shards)


def _even(loads: np.ndarray, out: np.ndarray, shards: int, tolerance: float = 0.002, most: float = 0.02) -> np.ndarray:
    """The law of equal bytes comes first: while the fullest and the emptiest shard differ by more than ``tolerance``
    of a shard, the unit whose size is nearest to half the difference moves from the one to the other. Units that would
    lift the other loads of the emptiest shard over ``most`` above the mean only move if there are no others."""
    size = loads[:, 0]
    load = np.bincount(out, size, shards)
    others = np.array([np.bincount(out, x, shards) for x in loads.T[1:]])
    room = loads.sum(0)[1:] / shards * (1 + most)
    for _ in range(4 * len(size)):
        high, low = int(load.argmax()), int(load.argmin())
        gap = load[high] - load[low]
        if gap <= tolerance * load.sum() / shards:
            break
        own = np.flatnonzero((out == high) & (size > 0))
        mild = own[(others[:, low] + loads[own, 1:] <= room).all(1) & (size[own] < gap)]
        own = mild if len(mild) else own
        if not len(own):
            break
        best = own[np.abs(size[own] - gap / 2).argmin()]
        if size[best] >= gap:
            break
        out[best] = low
        others[:, high] -= loads[best, 1:]
        others[:, low] += loads[best, 1:]
        load[high] -= size[best]
        load[low] += size[best]
    return out


def pack_groups(loads: np.ndarray, group: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unit, where the units of one ``group`` are pieces of it and stay together. Cut are groups that no
    shard can hold and, as equal bytes come first, the largest of the others (twice as many each time) while the bytes
    are less even than ``TOLERANCE``."""
    total = loads.sum(0)
    share = (loads / np.where(total > 0, total, 1)) * shards
    names, own = np.unique(group, return_inverse=True)
    whole = np.zeros((len(names), loads.shape[1]))
    np.add.at(whole, own, share)
    several = np.bincount(own, minlength=len(names)) > 1
    size = whole.max(1, initial=0)
    cut = several & (size > 1)
    more = 1
    while True:
        _, unit = np.unique(np.where(cut[own], len(names) + np.arange(len(own)), own), return_inverse=True)
        merged = np.zeros((unit.max(initial=-1) + 1, loads.shape[1]))
        np.add.at(merged, unit, loads)
        out = pack(merged, shards)
        left = np.flatnonzero(several & ~cut)
        if not len(left) or np.ptp(np.bincount(out, merged[:, 0], shards)) <= TOLERANCE * total[0] / shards:
            return out[unit]
        cut[left[np.argsort(-size[left], kind="stable")[:more]]] = True
        more *= 2


def _sums() -> list:
    return [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")]


def _with_unit(rows: DataFrame, large: DataFrame) -> DataFrame:
    """``rows(id, h, ...)`` with the name of the unit that each row is placed with."""
    rows = rows.join(F.broadcast(large), F.col("h") == F.col("large"), "left")
    piece = F.pmod(F.xxhash64("id", F.lit(5)), F.col("pieces"))
    bundle = F.concat(F.lit("b"), F.pmod(F.xxhash64("h", F.lit(3)), F.lit(BUNDLES)))
    own = F.concat(F.lit("g"), F.hex("h"), F.lit("-"), piece)
    return rows.withColumn("unit", F.when(F.col("large").isNull(), bundle).otherwise(own)).drop("large", "pieces")


def place(docs: DataFrame, shards: int = 8, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(slim rows, large groups, units)``: ``(id, size, tokens, text_crc32, h, shard, __cell)``, ``(large, pieces)``
    and ``(unit, shard)``.

    Groups of equal texts are found by a 64-bit hash. A group below a 4096th of the whole is bundled with others by
    that hash (two texts of one hash merely share a bundle); larger groups are units of their own, whose loads are known
    for pieces of that size, by a hash of ``key``. A group stays whole unless it exceeds a shard or the bytes wouldn't be
    even (``pack_groups``). So there are at most a few times 4096 units whatever the input, and only those reach the driver.
    """
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    slim = materialise(docs.select(
        F.col(key).alias("id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long").alias("size"),
        word_count(F.col(text)).alias("tokens"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(F.col(text)).alias("h"),
    ))
    groups = slim.groupBy("h").agg(*_sums())
    all_ = slim.agg(*_sums()).first()
    share = F.greatest(*[F.col(c) / F.lit(float(max(all_[c] or 0, 1))) for c in ("size", "tokens", "n")])
    # at most 3 x 4096 rows, for each holds over a 4096th of one of the three sums: small enough to broadcast
    large = materialise(groups.withColumn("share", share).filter(F.col("share") * BUNDLES > 1).select(
        F.col("h").alias("large"), F.least(F.ceil(F.col("share") * BUNDLES), F.col("n")).alias("pieces")
    ))
    rows = _with_unit(slim, large)
    loads = rows.groupBy("unit").agg(*_sums()).orderBy("unit").collect()
    sums = np.array([[r["size"], r["tokens"], r["n"]] for r in loads], float).reshape(-1, 3)
    put = pack_groups(sums, np.array([r["unit"].split("-")[0] for r in loads], str), shards)
    units = docs.sparkSession.createDataFrame([(r["unit"], int(s)) for r, s in zip(loads, put, strict=True)], "unit string, shard int")
    cell = F.pmod(F.xxhash64("id", "h"), F.lit(max(32, (all_["n"] or 0) // SLOT_ROWS)))
    return rows.join(F.broadcast(units), "unit").drop("unit").withColumn("__cell", cell), large, units


def _with_slots(rows: DataFrame, counted: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with a gapless ``slot`` from 0 in each shard. Rows are numbered inside small cells of a shard; each
    cell starts where the cells before it end (``counted`` has the same rows). So no task sorts a whole shard."""
    count = counted.groupBy("shard", "__cell").agg(F.count(F.lit(1)).alias("__n"))
    run = Window.partitionBy("shard").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    start = count.select("shard", "__cell", F.coalesce(F.sum("__n").over(run), F.lit(0)).alias("__start"))
    nth = F.row_number().over(Window.partitionBy("shard", "__cell").orderBy(*order)) - 1
    rows = rows.withColumn("__nth", nth).join(start, ["shard", "__cell"])
    return rows.withColumn("slot", (F.col("__start") + F.col("__nth")).cast("long")).drop("__start", "__nth")


def shard(docs: DataFrame, shards: int = 8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, size, text_crc32, law, shard, slot, grown_shard)``, one row per row of ``docs``.

    Sizes of the shards (UTF-8 bytes plus 1 per document) come out nearly equal, which is the law ``bytes``; tokens
    and rows are balanced along. Null text counts as no bytes; equal rows are numbered in any order, which their
    values can't show; rows with a null key are placed like others. An empty table stays empty.
    """
    rows, _, _ = place(docs, shards, text, key)
    out = _with_slots(rows, rows, ["id", "text_crc32", "size"])
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return out.select(F.col("id").alias(key), "size", "text_crc32", law, "shard", "slot", grown)


def shard_rows(docs: DataFrame, shards: int = 8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with ``shard`` and ``slot`` (columns of these names are replaced): the same placement, text included."""
    slim, large, units = place(docs, shards, text, key)
    own = [c for c in docs.columns if c not in ("shard", "slot")]
    rows = docs.select(F.struct(*own).alias("__row"), F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("h"))
    cell = F.pmod(F.xxhash64("id", "h"), F.lit(max(32, slim.count() // SLOT_ROWS)))
    rows = _with_unit(rows, large).join(F.broadcast(units), "unit").withColumn("__cell", cell)
    return _with_slots(rows, slim, ["id", "h"]).select("__row.*", "shard", "slot")
