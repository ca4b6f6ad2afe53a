"""Rules whose outcome depends on the order of comments."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from verdictlab.functions.scalars import identity_keys
from verdictlab.functions.shared import materialise


def first_approved(df: DataFrame, key: str, order: str, spam: str) -> DataFrame:
    """``(key, first)``: the first row of each key, if any, that isn't spam by its content."""
    return df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(F.when(~F.col(spam), F.col(order))).alias("first"))


def approved_email(df: DataFrame, key: str, order: str, spam: str) -> DataFrame:
    """``df`` with ``trusted`` and ``final_spam``: a row is trusted when its key has an earlier row that isn't spam by
    its content (a null key is never trusted); trusted rows aren't spam.

    The first approved row per key decides, so this is one aggregate and one join: a hot key is folded before the
    shuffle, and no window has to hold all its rows.
    """
    first = first_approved(df, key, order, spam).toDF("__k", "__first")
    j = df.join(first, F.col(key) == F.col("__k"), "left")
    trusted = F.coalesce(F.col("__first") < F.col(order), F.lit(False))
    return j.withColumn("trusted", trusted).withColumn("final_spam", F.col(spam) & ~F.col("trusted")).drop("__k", "__first")


#: Comments that one task folds at once; it holds the states of their keys.
BLOCK = 200_000

_FOLDED = "block int, comment_id long, content_spam boolean, repeat boolean, trusted boolean, spam boolean, key string, bad boolean, good boolean"


def db_spam(df: DataFrame, seeds: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(comment_id, seed)`` of every comment that is spam by itself (``seeds``) or shares an address, e-mail or URL
    with an earlier spam. Folded as in ``ordered_rules``, for chains of any length."""
    found = _fold_in_blocks(df, seeds, False, block)
    return found.filter("spam").select("comment_id", F.col("content_spam").alias("seed"))


def ordered_rules(df: DataFrame, seeds: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(comment_id, content_spam, repeat, trusted, spam)`` with both order-dependent rules at once.

    In id order: a comment whose e-mail has an earlier approved comment is trusted, so not spam; else it is spam when
    its content is, or when it shares an address, e-mail or URL with an earlier spam.

    Ids are cut into ranges of ``block`` comments or so. Each is folded in order by one task, all side by side, and tells which
    keys it leaves with a spam or an approved comment. A range is folded again if ranges before it have left keys of its own
    in another state than it was folded with, until none has changed. The first range is right at once, and each pass
    makes at least the next one right, so the passes are bounded by the ranges, not by the length of a chain; only ranges
    that changed are read again, and only keys of more than one range are looked at. No key or cluster is gathered.
    Repeated rows of an id are one comment. Each pass is written to the shared folder.
    """
    return _fold_in_blocks(df, seeds, True, block).select("comment_id", "content_spam", "repeat", "trusted", "spam")


def _fold_in_blocks(df: DataFrame, seeds: DataFrame, trust: bool, block: int) -> DataFrame:
    none = F.lit(None)
    own = identity_keys(df).select("comment_id", "key", F.lit(False).alias("seed"))
    both = own.unionByName(seeds.select("comment_id", none.cast("string").alias("key"), F.lit(True).alias("seed")))
    rows = materialise(both.groupBy("comment_id").agg(F.array_sort(F.collect_set("key")).alias("keys"), F.max("seed").alias("content_spam")))
    if trust:  # seeds that aren't comments of df have no keys
        rows = rows.filter(F.size("keys") > 0)
    n = max(1, -(-rows.count() // block))
    rows = materialise(rows.repartitionByRange(n, "comment_id").withColumn("block", F.spark_partition_id()))
    found = materialise(_folded(rows, None, trust))
    of_keys = found.filter("key is not null").select("block", "key", "bad", "good")
    many = of_keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    shared = materialise(of_keys.join(many, "key", "left_semi").withColumn("was_bad", F.lit(False)).withColumn("was_good", F.lit(False)))
    done = found.filter("key is null")
    while True:
        first = shared.groupBy("key").agg(F.min(F.when(F.col("bad"), F.col("block"))).alias("b"), F.min(F.when(F.col("good"), F.col("block"))).alias("g"))
        before = lambda c: F.coalesce(F.col(c) < F.col("block"), F.lit(False))
        told = materialise(shared.join(first, "key").select("block", "key", "bad", "good", "was_bad", "was_good", before("b").alias("now_bad"), before("g").alias("now_good")))
        stale = told.filter("now_bad <> was_bad or now_good <> was_good").select("block").distinct()
        if stale.isEmpty():
            return done
        again = rows.join(stale, "block", "left_semi")
        given = told.join(stale, "block", "left_semi").filter("now_bad or now_good").select("block", "key", F.col("now_bad").alias("bad"), F.col("now_good").alias("good"))
        new = materialise(_folded(again, given, trust))
        states = new.filter("key is not null").select("block", "key", F.col("bad").alias("new_bad"), F.col("good").alias("new_good"))
        j = told.join(states, ["block", "key"], "left")
        shared = materialise(j.select("block", "key", F.coalesce("new_bad", "bad").alias("bad"), F.coalesce("new_good", "good").alias("good"), F.col("now_bad").alias("was_bad"), F.col("now_good").alias("was_good")))
        done = materialise(done.join(stale, "block", "left_anti").unionByName(new.filter("key is null")))


def _folded(rows: DataFrame, given: DataFrame | None, trust: bool) -> DataFrame:
    """The comments of each block with their verdicts, and the keys of each block with their states at its end."""
    none = F.lit(None)
    cols = ["block", "comment_id", "keys", "content_spam", "bad", "good"]
    flat = rows.select("block", "comment_id", "keys", "content_spam", none.cast("boolean").alias("bad"), none.cast("boolean").alias("good"))
    if given is not None:
        flat = flat.unionByName(given.select("block", none.cast("long").alias("comment_id"), F.array("key").alias("keys"), none.cast("boolean").alias("content_spam"), "bad", "good"))
    n = rows.select("block").distinct().count()
    # what is given comes in front of the comments
    flat = flat.repartition(max(n, 1), "block").sortWithinPartitions("block", F.col("comment_id").asc_nulls_first()).select(*cols)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "comment_id", "content_spam", "repeat", "trusted", "spam", "key", "bad", "good"]
        now, bad, good, seen, spam_of, good_of = None, set(), set(), set(), set(), set()
        for b in batches:
            out = []
            for block, id_, keys, content, was_bad, was_good in zip(*(b[c].to_pylist() for c in cols), strict=True):
                if block != now:
                    out += [(now, None, None, None, None, None, k, k in spam_of, k in good_of) for k in seen]
                    now, bad, good, seen, spam_of, good_of = block, set(), set(), set(), set(), set()
                if id_ is None:
                    if was_bad:
                        bad.add(keys[0])
                    if was_good:
                        good.add(keys[0])
                    continue
                repeat = any(k in bad for k in keys)
                trusted = trust and any(k in good for k in keys if k[:2] == "e:")
                spam = not trusted and (content or repeat)
                seen.update(keys)
                if spam:
                    bad.update(keys)
                    spam_of.update(keys)
                else:
                    mail = [k for k in keys if k[:2] == "e:"]
                    good.update(mail)
                    good_of.update(mail)
                out.append((block, id_, content, repeat, trusted, spam, None, None, None))
            yield _batch(out, names)
        yield _batch([(now, None, None, None, None, None, k, k in spam_of, k in good_of) for k in seen], names)

    return flat.mapInArrow(fold, _FOLDED)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), *[pa.bool_()] * 4, pa.string(), pa.bool_(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 9, kinds, strict=True)], names=names)
