"""From LSH band keys to classes of similar things, without all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from verdictlab.functions.shared import materialise
from verdictlab.llm.text import list_array
from verdictlab.operators.components import connected_components

#: Rounds in which the members of a bucket that are unlike its leaders so far get a new leader.
ROUNDS = 2
#: Members of a bucket up to which all are compared with each other.
SMALL = 32
#: Cells in which tokens are counted, and slices of them that are added up side by side.
CELLS, SLICES = 1 << 22, 64
#: Bits of a sieve.
BITS = 1 << 27
#: Bits in which sets are compared before they are verified, 64 in a number.
PARITY = 256
#: Keys that a task sorts and deals out at once, or takes in before it adds them up.
DEALT = 1 << 20
#: Members of a block: what one task of the exact finish pairs with the other members of a token.
BLOCK = 2000


def classes(signatures: DataFrame, prepare: Callable[[DataFrame], tuple[Callable, Callable]], similar: float, rounds: int = ROUNDS) -> DataFrame:
    """``(id, class)`` for each ``id`` of ``signatures(id, keys array<bigint>)`` that has a similar partner; the class
    is named by its smallest id. Keys of different bands differ; rows of one id have the same keys and may be repeated.

    ``prepare(ids)`` gets the ids that share a key with another one and returns ``score``, which gives
    ``(a, b, s)`` of those ``pairs(a, b)`` whose similarity ``s`` is ``2 * similar - 1`` or more, and ``tokens``, which gives
    ``(id, toks array<bigint>)`` of some of the ids: sets whose Jaccard similarity is no less than ``s``. ``1 - s`` is
    a metric.

    The members of a bucket of up to ``SMALL`` are all compared with each other. In a larger one they are compared with
    one leader, the member that meets most others over all
    buckets (an original meets its copies more often than they meet each other). So pairs grow with the members, not
    with their square, and no larger bucket is gathered: sizes, leaders and links are aggregates and equi-joins. Members
    that are unlike their leader get a new one among themselves, in up to ``rounds`` rounds. The classes are the
    connected components of all links. What could still be missing is finished exactly (``_finish``): pairs of members
    unlike all leaders; and pairs of a member like a leader with one unlike it. By the triangle inequality the latter
    can only be similar where their similarities to the leader differ by no more than ``1 - similar``. So two ids that share a bucket
    and are similar always end in one class; there is no cap on members, leaders or links.
    """
    spark = signatures.sparkSession
    n = materialise(_shared(signatures))
    if n.isEmpty():
        return spark.createDataFrame([], "id bigint, class bigint")
    # a bucket of two rows is known by its ends; the members of others are looked up
    two = n.filter("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b")).distinct()
    _, some = sieve(n.filter("n > 2").select(F.col("key").alias("x")))
    # members and sizes are written first: a hot key is then split by AQE in the join, which feeds a write only
    m = materialise(signatures.select("id", F.explode(some("keys")).alias("key")).distinct())
    sizes = materialise(m.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    m = materialise(m.join(sizes, "key").select("id", "key", "n"))
    score, tokens = prepare(materialise(m.select("id").unionByName(two.select(F.explode(F.array("a", "b")).alias("id"))).distinct()))
    pairs = _all_pairs(m.filter(F.col("n") <= SMALL)).unionByName(two)
    m = m.filter(F.col("n") > SMALL)
    scored = done = None
    like, near = [], []
    for k in range(rounds):
        if k:
            n = m.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
            m = materialise(m.join(n, "key").select("id", "key", "n"))
            if m.isEmpty():
                break
        central = m.groupBy("id").agg(F.sum("n").alias("weight"))
        lead = m.join(central, "id").groupBy("key").agg(F.max(F.struct("weight", (-F.col("id")).alias("neg"))).alias("x"))
        met = m.join(lead.select("key", (-F.col("x.neg")).alias("leader")), "key").filter("id <> leader")
        met = materialise(met.withColumn("a", F.least("id", "leader")).withColumn("b", F.greatest("id", "leader")))
        own = met.select("a", "b").distinct()
        pairs = own.unionByName(pairs).distinct() if done is None else own.join(done, ["a", "b"], "left_anti")
        pairs = materialise(pairs)
        new = materialise(score(pairs).select("a", "b", "s"))
        scored = new if scored is None else scored.unionByName(new)
        done = pairs if done is None else done.unionByName(pairs)
        judged = materialise(met.join(scored, ["a", "b"], "left").drop("a", "b"))
        like.append(judged.filter(F.col("s") >= similar).select("key", "id", "leader", "s"))
        near.append(judged.filter(F.col("s") < similar).select("key", "id", "leader", "s"))
        m = materialise(judged.filter(F.col("s").isNull() | (F.col("s") < similar)).select("id", "key"))
    links = scored.filter(F.col("s") >= similar).select("a", "b")
    found = materialise(connected_components(links))
    open_ = _open(m, reduce(DataFrame.unionByName, like), reduce(DataFrame.unionByName, near), found, 1 - similar)
    found = _finish(open_, found, lambda pairs: score(pairs).filter(F.col("s") >= similar), tokens, similar)
    return found.select(F.col("node").alias("id"), F.col("component").alias("class"))


def _counted(key: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """``(key, lo)`` of the keys that stand once, with ``n`` of 1, and ``(key, least lo, greatest hi, sum of n)`` of others; both in order."""
    order = np.argsort(key)
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]][: len(key)]
    alone = new & np.r_[new[1:], True][: len(key)]
    alone[alone] = n[order[alone]] == 1
    rest = order[~alone]
    at = np.flatnonzero(new[~alone])
    if len(at):
        more = key[~alone][at], np.minimum.reduceat(lo[rest], at), np.maximum.reduceat(hi[rest], at), np.add.reduceat(n[rest], at)
    else:
        more = key[:0], lo[:0], hi[:0], n[:0]
    return (key[alone], lo[order[alone]]), more


def _shared(signatures: DataFrame) -> DataFrame:
    """``(key, lo, hi, n)`` of the keys that two ids or more have: the least and greatest of them, and the rows. A group-by of
    keys of which nearly all stand once, so tasks send sorted runs of them, one row a slice of the hashed keys, instead of a row each. A
    run has a key once, so a common key is a few numbers a task; only a key's first id is sent where it has no other."""
    slices = 4 * int(signatures.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def deal(batches):
        def runs(key, row):
            for cols in _counted(key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15), row, row, np.ones(len(row), np.int64)):
                of = ((cols[0] >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)
                first = np.flatnonzero(np.diff(of, prepend=-1))
                if len(first):
                    ends = pa.py_buffer((8 * np.r_[first, len(of)]).astype(np.int32))
                    lists = [pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, ends, pa.py_buffer(x)]) for x in cols]
                    lists += [pa.array([b""] * len(first), pa.binary())] * (4 - len(cols))
                    yield pa.RecordBatch.from_arrays([pa.array(of[first]), *lists], names=["slice", "key", "lo", "hi", "n"])

        keys, ids, size = [], [], 0
        for b in batches:
            keys.append(b["keys"].flatten().to_numpy(zero_copy_only=False))
            ids.append(np.repeat(b["id"].to_numpy(), b["keys"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
            size += len(keys[-1])
            if size >= DEALT:
                yield from runs(np.concatenate(keys), np.concatenate(ids))
                keys, ids, size = [], [], 0
        if size:
            yield from runs(np.concatenate(keys), np.concatenate(ids))

    def add(batches):
        none = np.zeros(0, np.int64)
        new, size, most = [(none.view(np.uint64), none, none, none)], 0, DEALT

        def added():
            return _counted(*(np.concatenate(x) for x in zip(*new, strict=True)))

        for b in batches:
            for key, lo, hi, n in zip(*(b[x] for x in ("key", "lo", "hi", "n")), strict=True):
                key, lo, hi, n = (np.frombuffer(x.as_buffer(), np.int64) for x in (key, lo, hi, n))
                new.append((key.view(np.uint64), lo, hi if len(hi) else lo, n if len(n) else np.ones(len(key), np.int64)))
                size += len(key)
                if size > most:
                    (key, lo), more = added()
                    new = [(key, lo, lo, np.ones(len(key), np.int64)), more]
                    size = len(key) + len(more[0])
                    most = max(DEALT, 2 * size)
        _, (key, lo, hi, n) = added()
        own = lo < hi
        key = key[own] * np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
        for at in range(0, len(key), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)]) for x in (key.view(np.int64), lo[own], hi[own], n[own])], names=["key", "lo", "hi", "n"])

    runs = signatures.select("id", "keys").mapInArrow(deal, "slice long, key binary, lo binary, hi binary, n binary")
    return runs.repartition(slices // 4, "slice").mapInArrow(add, "key long, lo long, hi long, n long")


def sieve(values: DataFrame) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """Two functions of a column of numbers and of one of lists of numbers: whether a number may be among ``values(x)``, and
    those of a list that may be. A number that is among them always passes; of others some do, by chance, so a join or a
    count follows. It spares the shuffle of what has no partner. ``BITS`` bits are broadcast, whatever the input."""
    spark = values.sparkSession
    words = values.groupBy(F.expr(f"cast(pmod(x, {BITS}L) div 64 as int)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(x, 64L) as int))")).alias("bits")).toArrow()
    bits = np.zeros(BITS // 64, np.int64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy()
    shared = spark.sparkContext.broadcast(bits)

    def passes(x: np.ndarray) -> np.ndarray:
        return (shared.value[(x & (BITS - 1)) >> 6] >> (x & 63)) & 1 == 1

    @F.arrow_udf("boolean")
    def one(x: pa.Array) -> pa.Array:
        return pa.array(passes(x.to_numpy(zero_copy_only=False)))

    @F.arrow_udf("array<bigint>")
    def some(lists: pa.Array) -> pa.Array:
        x = lists.flatten().to_numpy(zero_copy_only=False)
        size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        keep = passes(x)
        row = np.repeat(np.arange(len(size)), size)
        return list_array(pa.array(x[keep]), np.bincount(row[keep], minlength=len(size)))

    return one.asNondeterministic(), some.asNondeterministic()


def _parity(x: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` rows ``PARITY`` bits, each whether an odd number of its tokens falls on it. Two sets differ in no
    fewer tokens than bits."""
    bit = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PARITY.bit_length() + 1)
    odd = np.bincount(row * PARITY + bit.astype(np.int64), minlength=n * PARITY) & 1
    return np.packbits(odd.astype(bool)).view(np.int64).reshape(n, PARITY // 64)


def _all_pairs(m: DataFrame) -> DataFrame:
    """``(a, b)``, a < b, of all members ``(id, key)`` of each bucket; the buckets are small. Equal buckets are one."""
    ids = m.groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids")).select("ids").distinct()
    of = F.transform("ids", lambda x, i: F.transform(F.slice("ids", i + 2, F.size("ids")), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    return ids.select(F.explode(F.flatten(of)).alias("p")).select("p.a", "p.b").distinct()


def _open(left: DataFrame, like: DataFrame, near: DataFrame, found: DataFrame, apart: float) -> DataFrame:
    """``(id, c)`` of all that may have a similar partner of another class ``c``: members of a bucket that no leader is
    like (``left``), and members ``near`` a leader of another class with those that are ``like`` it in that bucket, if
    their similarities ``s`` to it are no more than ``apart`` from each other."""
    named = _named(left, found)
    keys = named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("key")
    first = named.join(keys, "key", "left_semi").select("id", "c")
    apart += 1e-9
    near = _named(near, found).withColumnRenamed("c", "own")
    near = _named(near.withColumnsRenamed({"id": "other", "leader": "id"}), found).filter("c <> own").withColumnsRenamed({"id": "leader", "s": "t"})
    least = like.groupBy("key", "leader").agg(F.min("s").alias("least"))
    near = materialise(near.join(least, ["key", "leader"]).filter(F.col("t") >= F.col("least") - apart).select("key", "leader", "other", "own", "t"))
    most = near.groupBy("key", "leader").agg(F.max("t").alias("most"))
    beside = like.join(most, ["key", "leader"]).filter(F.col("s") <= F.col("most") + apart).select("id").distinct()
    both = near.select(F.col("other").alias("id"), F.col("own").alias("c")).unionByName(_named(beside, found))
    return first.unionByName(both).distinct()


def _named(ids: DataFrame, found: DataFrame) -> DataFrame:
    """``ids(id, ...)`` with the class ``c`` that each has so far."""
    own = found.select(F.col("node").alias("id"), "component")
    return ids.join(own, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")


def _rarity(sets: DataFrame) -> np.ndarray:
    """How many tokens of ``sets(id, toks, c)`` fall into each of ``CELLS`` cells; 0 where all are of one class ``c``. A batch
    of sets is counted in its task, so a slice of cells is one row a batch, however many tokens there are, and slices are added up
    batch by batch."""
    cells, width = CELLS, CELLS // SLICES

    def tally(batches):
        for b in batches:
            cell = b["toks"].flatten().to_numpy(zero_copy_only=False) % cells
            if not len(cell):
                continue
            c = np.repeat(b["c"].to_numpy(), b["toks"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            order = np.argsort(cell, kind="stable")
            cell, c = cell[order], c[order]
            at = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            n, lo, hi = np.diff(np.r_[at, len(cell)]), np.minimum.reduceat(c, at), np.maximum.reduceat(c, at)
            part = cell[at] // width
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            ends = pa.array(np.r_[first, len(at)], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int64())) for x in (cell[at] % width, n, lo, hi)]
            yield pa.RecordBatch.from_arrays([pa.array(part[first], pa.int64()), *lists], names=["slice", "cell", "n", "lo", "hi"])

    def add(batches):
        found: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for b in batches:
            for i, part in enumerate(b["slice"].to_pylist()):
                if part not in found:
                    found[part] = np.zeros(width, np.int64), np.full(width, np.iinfo(np.int64).max), np.full(width, np.iinfo(np.int64).min)
                at, n, lo, hi = (b[x][i].values.to_numpy() for x in ("cell", "n", "lo", "hi"))
                total, least, most = found[part]
                total[at] += n
                least[at], most[at] = np.minimum(least[at], lo), np.maximum(most[at], hi)
        for part, (total, least, most) in found.items():
            at = np.flatnonzero(least < most)
            ends = pa.array([0, len(at)], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int64())) for x in (part * width + at, total[at])]
            yield pa.RecordBatch.from_arrays(lists, names=["cell", "n"])

    parts = sets.select("c", "toks").mapInArrow(tally, "slice long, cell array<long>, n array<long>, lo array<long>, hi array<long>")
    found = parts.repartition(SLICES, "slice").mapInArrow(add, "cell array<long>, n array<long>").toArrow()
    count = np.zeros(CELLS, np.int32)
    for cell, n in zip(found["cell"], found["n"], strict=True):
        count[cell.values.to_numpy()] = np.minimum(n.values.to_numpy(), np.iinfo(np.int32).max)
    return count


def _need(size: str, other: str, similar: float) -> Column:
    """The least number of tokens that sets of these sizes share if they are similar."""
    return F.ceil(similar / (1 + similar) * (F.col(size) + F.col(other)) - 1e-9)


def _paired(x: DataFrame, similar: float) -> DataFrame:
    """The rows of ``x(id, c, size, tok, left, ...)`` that may have a partner in another class, with the number of ``blocks`` of
    their token. ``left`` counts the tokens of a set from ``tok`` on, which must be as many as similar sets share. Of a pair the
    smaller set must have as many left as a set of its own size would need (a shorter prefix); so a set with fewer left needs
    a smaller partner, and the smallest such set of the token tells whether there may be one."""
    short = F.col("left") >= _need("size", "size", similar)
    both = x.groupBy("tok").agg(
        F.min("c").alias("lo"), F.max("c").alias("hi"), F.min(F.when(short, F.col("size"))).alias("small"),
        F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"),
    )
    both = both.filter("lo <> hi and small is not null").select("tok", "small", "blocks")
    return x.join(both, "tok").filter(F.col("left") >= _need("size", "small", similar)).drop("small")


def _finish(open_: DataFrame, found: DataFrame, verify: Callable, tokens: Callable, similar: float) -> DataFrame:
    """The classes ``(node, component)`` ``found``, and of all links between the members of ``open_(id, c)``. An exact
    prefix-filtered join: tokens are ordered by rarity, and sets of a Jaccard similarity of ``similar`` share one of
    their first ``n - ceil(similar * n) + 1`` tokens. Pairs whose sets differ in more tokens than they may, by their parity bits, aren't made. Any order of tokens will do, so rarity is counted in ``CELLS`` cells
    of their hash, which are broadcast; cells that only one class has come first, and their tokens aren't sent. Only
    pairs of different classes are made; the members of a token are paired in blocks, so a common token is no single
    task."""
    ids = materialise(open_)
    if ids.isEmpty():
        return found
    spark = ids.sparkSession
    sets = materialise(tokens(ids.select("id").distinct()).select("id", "toks").join(ids, "id"))
    shared = spark.sparkContext.broadcast(_rarity(sets))

    bits = [f"b{i}" for i in range(PARITY // 64)]

    @F.arrow_udf(f"struct<at: array<struct<tok: bigint, left: int>>, {', '.join(f'{b}: bigint' for b in bits)}>")
    def prefix(lists: pa.Array) -> pa.Array:
        own = lists.flatten().to_numpy(zero_copy_only=False)
        size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        n, row = shared.value[own % CELLS], np.repeat(np.arange(len(size)), size)
        parity = _parity(own, row, len(size))
        order = np.lexsort((own, n, row))
        own, n = own[order], n[order]
        place = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
        total = np.repeat(size, size)
        keep = (n > 0) & (place < total - np.ceil(similar * total - 1e-9) + 1)
        made = pa.StructArray.from_arrays([pa.array(own[keep].astype(np.int64)), pa.array((total - place)[keep].astype(np.int32))], names=["tok", "left"])
        at = list_array(made, np.bincount(row[keep], minlength=len(size)))
        return pa.StructArray.from_arrays([at, *[pa.array(np.ascontiguousarray(p)) for p in parity.T]], names=["at", *bits])

    x = sets.select("id", "c", F.size("toks").alias("size"), prefix.asNondeterministic()("toks").alias("p")).select("id", "c", "size", "p.*")
    x = materialise(x.select("id", "c", "size", *bits, F.explode("at").alias("p")).select("id", "c", "size", *bits, "p.tok", "p.left"))
    x = _paired(x, similar)
    one = x.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = ["tok", *[F.col(c).alias(f"{c}_b") for c in ("id", "size", "left", "c", *bits)]]
    many = x.filter("blocks > 1").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    two = x.filter("blocks = 1").select(*other, F.lit(0).alias("block")).unionByName(many.select(*other, "block"))
    need = _need("size", "size_b", similar)
    apart = reduce(Column.__add__, [F.bit_count(F.col(b).bitwiseXOR(F.col(f"{b}_b"))) for b in bits])
    pairs = one.join(two, ["tok", "block"]).filter((F.col("id") < F.col("id_b")) & (F.col("c") != F.col("c_b")) & (F.least("left", "left_b") >= need) & (apart <= F.col("size") + F.col("size_b") - 2 * need))
    more = materialise(verify(materialise(pairs.select(F.col("id").alias("a"), F.col("id_b").alias("b")).distinct())).select("a", "b"))
    shared.destroy()
    if more.isEmpty():
        return found
    return connected_components(more.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b"))))
