"""Conversation repair: the cheapest edits that make the roles alternate, by Viterbi over chunks that run abreast."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from verdictlab.functions.shared import materialise
from verdictlab.llm.text import bounded_batches

# Roles by initial. A conversation is legal if the initials read (s?(ua)+)? .
ROLES = "sua"
LEGAL = ("su", "ua", "au")

#: Costs of the edits; a truncated row that stays costs LEFT_OPEN more.
KEEP, REROLE, DELETE, INSERT, LEFT_OPEN = 0, 1, 2, 5, 5

#: States: nothing yet, after the system's turn, after the user's, after the assistant's. What may come next, by state.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
INF = 1 << 40

#: A row's code is its role (0 to 3, 3: another one) plus four times its kind.
FINE, OPEN, GONE = 0, 4, 8

#: Rows of a chunk at most, and passes that rerun chunks before what is still open is told by whole matrices.
CHUNK, FIXUPS = 4096, 4


@dataclass(frozen=True)
class Option:
    """What may be done before and with a row: the edits' initials, their cost, the state after them and the new roles."""

    edits: str
    cost: int
    then: int
    roles: str


def _inserts(state: int) -> Iterator[tuple[int, int, str]]:
    """``(inserts, state after them, inserted roles)``; after two the states come round again."""
    roles = ""
    for n in range(3):
        yield n, state, roles
        role = "a" if state == USER else "u"
        state, roles = NEXT[state][role], roles + role


def options(state: int, code: int) -> list[Option]:
    """All that may be done with a row of ``code`` in ``state``, by the edits in ASCII order. No edits are the beginning
    of others, so the first cheapest option of each row makes the least audit of all."""
    kind, role, found = code & 12, (ROLES + "?")[code & 3], []
    for n, at, made in _inserts(state):
        cost = n * INSERT
        found.append(Option("I" * n + "D", cost + DELETE, at, made))
        if kind != GONE:
            extra = LEFT_OPEN if kind == OPEN else 0
            if role in NEXT[at]:
                found.append(Option("I" * n + "K", cost + KEEP + extra, NEXT[at][role], made))
            new = "a" if at == USER else "u"
            found.append(Option("I" * n + "R", cost + REROLE + extra, NEXT[at][new], made + new))
    return sorted(found, key=lambda o: o.edits)


#: The inserts that end a conversation legally, by state.
ENDINGS = ["", "ua", "a", ""]
END = [INSERT * len(e) for e in ENDINGS]

WIDTH = 9
_OPTIONS = [[options(s, c) for s in range(4)] for c in range(12)]
_ALL = sorted({o for row in _OPTIONS for cell in row for o in cell}, key=lambda o: (o.edits, o.then, o.cost, o.roles))
_COST = np.full((12, 4, WIDTH), INF, np.int64)
_THEN, _NO = np.zeros((12, 4, WIDTH), np.int64), np.zeros((12, 4, WIDTH), np.int64)
for _c, _s in product(range(12), range(4)):
    for _k, _o in enumerate(_OPTIONS[_c][_s]):
        _COST[_c, _s, _k], _THEN[_c, _s, _k], _NO[_c, _s, _k] = _o.cost, _o.then, _ALL.index(_o)


def step(codes: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Costs to the end before one row of each chunk, from those after it: ``v[chunk, state]``."""
    return (_COST[codes] + v[np.arange(len(v))[:, None, None], _THEN[codes]]).min(axis=2)


def parallel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether two cost vectors differ only by a constant."""
    d = a - b
    return (d == d[:, :1]).all(axis=1)


class _Chunks:
    """The codes of many chunks, walked abreast row by row; the longest come first, so those that are left are in front."""

    def __init__(self, codes: pa.Array):
        self.size = np.asarray(codes.value_lengths().to_numpy(zero_copy_only=False), np.int64)
        self.order = np.argsort(-self.size, kind="stable")
        self.values = np.asarray(codes.flatten().to_numpy(zero_copy_only=False), np.int64)
        self.first = np.append(0, np.cumsum(self.size))[:-1]
        self.longest = int(self.size.max()) if len(self.size) else 0

    def at(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        """``(chunks with more than j rows, places of their row j)``, counted from the front."""
        own = self.order[: int(np.searchsorted(-self.size[self.order], -j, "left"))]
        return own, self.first[own] + j

    def back(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        """The same, counted from the end."""
        own = self.order[: int(np.searchsorted(-self.size[self.order], -j, "left"))]
        return own, self.first[own] + self.size[own] - 1 - j


def backward(codes: pa.Array, seeds: np.ndarray) -> np.ndarray:
    """The cost vectors at the beginnings of chunks which end in ``seeds``."""
    c, v = _Chunks(codes), seeds.copy()
    for j in range(c.longest):
        own, at = c.back(j)
        v[own] = step(c.values[at], v[own])
    return v


def fix_up(codes: pa.Array, before: np.ndarray, seeds: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Rerun chunks with other seeds, beside the run ``before``, until the vectors differ only by a constant: from there
    on, so do all further ones, and the head stays what it is, up to that constant."""
    c, was, now = _Chunks(codes), before.copy(), seeds.copy()
    live = ~parallel(was, now)
    out = heads.copy()
    for j in range(c.longest):
        own, at = c.back(j)
        some = live[own]
        own, at = own[some], at[some]
        if not len(own):
            continue
        was[own], now[own] = step(c.values[at], was[own]), step(c.values[at], now[own])
        live[own[parallel(was[own], now[own])]] = False
    out[live] = now[live]
    return out


def trace(codes: pa.Array, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(options by row and first state, states after the chunks, costs, rows of the chunks)`` of the least cheapest
    edits, for each of the four states in which a chunk may begin."""
    c, v = _Chunks(codes), seeds.copy()
    costs = np.zeros((len(c.values), 4), np.int64)  # after each row
    for j in range(c.longest):
        own, at = c.back(j)
        costs[at] = v[own]
        v[own] = step(c.values[at], v[own])
    state = np.tile(np.arange(4), (len(c.size), 1))
    spent, chosen = np.zeros((len(c.size), 4), np.int64), np.zeros((len(c.values), 4), np.int64)
    for j in range(c.longest):
        own, at = c.at(j)
        code, s = c.values[at][:, None], state[own]
        total = _COST[code, s] + costs[at][np.arange(len(at))[:, None, None], _THEN[code, s]]
        k = total.argmin(axis=2)  # the first of the cheapest
        chosen[at] = _NO[code, s, k]
        spent[own] += _COST[code, s, k]
        state[own] = _THEN[code, s, k]
    return chosen, state, spent, c.size


def illegal_pairs(codes: pa.Array) -> np.ndarray:
    """Pairs of rows side by side in a chunk whose roles may not follow each other."""
    c = _Chunks(codes)
    ok = np.array([[a + b in LEGAL for b in ROLES + "?"] for a in ROLES + "?"])
    out = np.zeros(len(c.size), np.int64)
    role = c.values & 3
    for j in range(1, c.longest):
        own, at = c.at(j)
        out[own] += ~ok[role[at - 1], role[at]]
    return out


def _square(lists: pa.Array, n: int) -> np.ndarray:
    return np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(-1, n)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), pa.int64()))


def _level(v: np.ndarray) -> np.ndarray:
    return v - v.min(axis=1, keepdims=True)


_VECTOR = ArrayType(LongType())


@F.arrow_udf(_VECTOR)
def _backward(codes: pa.Array, seeds: pa.Array) -> pa.Array:
    return _lists(_level(backward(codes, _square(seeds, 4))))


@F.arrow_udf(_VECTOR)
def _fix_up(codes: pa.Array, before: pa.Array, seeds: pa.Array, heads: pa.Array) -> pa.Array:
    return _lists(_level(fix_up(codes, _square(before, 4), _square(seeds, 4), _square(heads, 4))))


@F.arrow_udf(_VECTOR)
def _transfer(codes: pa.Array) -> pa.Array:
    """The whole effect of a chunk: cost from state s to state t at 4 s + t."""
    unit = np.where(np.eye(4, dtype=bool), 0, INF)
    return _lists(np.stack([np.minimum(backward(codes, np.tile(u, (len(codes), 1))), INF) for u in unit], axis=2).reshape(-1, 16))


@F.arrow_udf(LongType())
def _illegal(codes: pa.Array) -> pa.Array:
    return pa.array(illegal_pairs(codes))


@F.arrow_udf(StructType([StructField("ends", _VECTOR), StructField("costs", _VECTOR), StructField("edits", ArrayType(_VECTOR))]))
def _trace(codes: pa.Array, seeds: pa.Array) -> pa.Array:
    chosen, ends, costs, size = trace(codes, _square(seeds, 4))
    # row by row for each first state: the lists of a chunk are the columns of its rows
    offs = np.append(0, np.cumsum(np.repeat(size, 4)))
    first = np.append(0, np.cumsum(size))
    flat = np.concatenate([chosen[a:b].T.ravel() for a, b in zip(first[:-1], first[1:], strict=True)]) if len(size) else np.zeros(0, np.int64)
    inner = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(flat, pa.int64()))
    outer = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1) * 4, pa.int32()), inner)
    return pa.StructArray.from_arrays([_lists(ends), _lists(costs), outer], names=["ends", "costs", "edits"])


# --- on tables

_SPACE = r"[\x20\x09-\x0D]"


def _ordered(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Conversations one after the other, each in the order of its turns, as ``(conv, turn, role, text, part, id, h)``.

    Ranges of all rows are sorted side by side, so a long conversation may lie in many of them; ``id`` rises with the
    order, without gaps inside a range. Equal rows are told apart by a number, so they may be cut as well."""
    r = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    key = F.concat(F.coalesce(F.col("conv").cast("string"), F.lit("~")), F.lit(":"), F.length("role"), F.lit(":"), F.col("role"), F.col("text"))
    r = r.withColumn("h", F.sha2(key, 256)).withColumn("__n", F.monotonically_increasing_id())
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 200), F.col("h"), F.col("__n")]
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    r = r.repartitionByRange(spread, *order).sortWithinPartitions(*order).drop("__n")
    return r.withColumn("id", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id())


def _faults(rows: DataFrame) -> DataFrame:
    """``rows`` with ``fault`` (the first of blank, duplicate and truncated) and ``code``."""
    again = rows.groupBy("h").agg(F.min("id").alias("__first"), F.count(F.lit(1)).alias("__n")).filter("__n > 1").drop("__n")
    r = rows.join(again, "h", "left")
    solid = F.regexp_replace("text", _SPACE, "")
    r = r.withColumn("fault", F.when(solid == "", "blank").when(F.col("id") > F.col("__first"), "duplicate").when(~solid.rlike(r"[.!?]\z"), "truncated"))
    place = F.instr(F.lit(ROLES), F.substring("role", 1, 1))
    role = F.when((F.col("role") == "") | (place == 0), 3).otherwise(place - 1)
    kind = F.when(F.col("fault") == "truncated", OPEN).when(F.col("fault").isNull(), FINE).otherwise(GONE)
    return r.withColumn("code", (role + kind).cast("int")).drop("__first", "h")


def _chunks(rows: DataFrame, size: int) -> DataFrame:
    """``(conv, at, first, codes)``: the rows of a conversation in each block of ``size`` rows of the order; ``at`` rises by
    one from block to block, so a conversation's chunks have numbers without gaps."""
    block = F.expr(f"(id & {(1 << 33) - 1}) div {size}")
    r = rows.select("conv", "part", "id", "code", block.alias("block"))
    # one row for each range: how many blocks the ranges before it have
    n = {x["part"]: x["n"] for x in r.groupBy("part").agg((F.max("block") + 1).alias("n")).collect()}
    start, seen = {}, 0
    for p in sorted(n):
        start[p], seen = seen, seen + n[p]
    starts = rows.sparkSession.createDataFrame(sorted(start.items()), "part int, start long")
    r = r.join(F.broadcast(starts), "part").withColumn("at", F.col("start") + F.col("block"))
    g = r.groupBy("conv", "at").agg(F.min("id").alias("first"), F.array_sort(F.collect_list(F.struct("id", "code"))).alias("codes"))
    return g.withColumn("codes", F.col("codes")["code"])


def _beside(d: DataFrame, other: DataFrame, on: str, how: str) -> DataFrame:
    """``d`` joined to the rows of the same conversation whose ``__at`` is its ``on``."""
    same = (F.col(on) == F.col("__at")) & F.col("conv").eqNullSafe(F.col("__conv"))
    return d.join(other, same, how).drop("__at", "__conv")


def _keyed(d: DataFrame, *cols: Column) -> DataFrame:
    return d.select(F.col("at").alias("__at"), F.col("conv").alias("__conv"), *cols)


def _chained(d: DataFrame) -> DataFrame:
    """``(conv, at, value)`` from ``(conv, at, to, value, matrix)``: a missing value is the min-plus product of the matrix and
    the value at ``to``. The matrices are joined over twice the distance each time, so the rounds are few."""
    d = materialise(d)
    while not d.filter("value is null").isEmpty():
        two = _keyed(d, F.col("value").alias("__v"), F.col("matrix").alias("__m"), F.col("to").alias("__to"))
        j = _beside(d, two, "to", "left")
        least = lambda s, cell: F.array_min(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda t: F.least(F.element_at("matrix", s * 4 + t + 1) + cell(t), F.lit(INF))))
        found = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda s: least(s, lambda t: F.element_at("__v", t + 1)))
        joined = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: least(F.floor(i / 4).cast("int"), lambda t: F.element_at("__m", t * 4 + i % 4 + 1)))
        open_ = F.col("value").isNull()
        value = F.when(open_ & F.col("__v").isNotNull(), found).otherwise(F.col("value"))
        matrix = F.when(open_ & F.col("__v").isNull(), joined).otherwise(F.col("matrix"))
        d = materialise(j.select("conv", "at", F.when(open_, F.col("__to")).otherwise(F.col("to")).alias("to"), value.alias("value"), matrix.alias("matrix")))
    return d.select("conv", "at", "value")


def _seeds(linked: DataFrame, fixups: int) -> DataFrame:
    """``linked`` chunks with ``seed``: the costs after their last row, up to a constant.

    Each chunk starts from a guess, the vector with which conversations end. A fix-up pass hands each chunk the vector at
    the head of the one after it and reruns those where it isn't what they started from. Where that goes on for more than
    ``fixups`` passes (rows that may as well all go carry a difference through any number of chunks), the matrices
    of the chunks tell the rest.
    """
    end = F.array(*[F.lit(x).cast("long") for x in END])
    runs = linked.withColumn("seed", end).withColumn("head", _backward(F.col("codes"), F.col("seed")))
    for _ in range(fixups):
        runs = materialise(runs)
        j = _beside(runs.withColumn("to", F.col("at") + 1), _keyed(runs, F.col("head").alias("__new")), "to", "left").drop("to")
        stale = F.coalesce(F.col("__new") != F.col("seed"), F.lit(False))
        if j.filter(stale).isEmpty():
            return runs.drop("head")
        head = F.when(stale, _fix_up(F.col("codes"), F.col("seed"), F.coalesce(F.col("__new"), F.col("seed")), F.col("head"))).otherwise(F.col("head"))
        runs = j.select("conv", "at", "first", "codes", "last", F.coalesce("__new", "seed").alias("seed"), head.alias("head"))
    to = F.col("at") + 1
    known = F.when(F.col("last"), _backward(F.col("codes"), end))
    heads = _chained(linked.select("conv", "at", to.alias("to"), known.alias("value"), _transfer(F.col("codes")).alias("matrix")))
    j = _beside(linked.withColumn("to", to), _keyed(heads, F.col("value").alias("__v")), "to", "left").drop("to")
    return j.withColumn("seed", F.coalesce("__v", end)).drop("__v")


def _begins(traced: DataFrame) -> DataFrame:
    """``traced`` linked chunks with ``begin``, the state before their first row: a chunk is traced from all four, and what it
    leads to is mostly the same; else the chunks before it tell."""
    table = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.when(F.element_at(F.col("t.ends"), i % 4 + 1) == F.floor(i / 4), F.lit(0).cast("long")).otherwise(F.lit(INF)))
    hot = lambda s: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when(i == s, F.lit(0).cast("long")).otherwise(F.lit(INF)))
    ends = F.col("t.ends")
    known = F.when(F.col("lead"), hot(ends[0])).when(F.array_min(ends) == F.array_max(ends), hot(ends[0]))
    after = _chained(traced.select("conv", "at", (F.col("at") - 1).alias("to"), known.alias("value"), table.alias("matrix")))
    state = (F.array_position("value", F.lit(0).cast("long")) - 1).cast("int")
    j = _beside(traced.withColumn("to", F.col("at") - 1), _keyed(after, state.alias("__s")), "to", "left").drop("to")
    return j.withColumn("begin", F.when(F.col("lead"), START).otherwise(F.col("__s"))).drop("__s")


@dataclass
class Repair:
    """``edits``: a row for each edit, ``(conv, turn, id, place, edit, role, text, fault)``, in the order of ``id, place``;
    role and text are those after the edit (of a deleted row: as it was). ``report``: a row for each conversation."""

    edits: DataFrame
    report: DataFrame


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = CHUNK, fixups: int = FIXUPS) -> Repair:
    """The cheapest edits that make each conversation's role initials ``(s?(ua)+)?``; of equally cheap ones those whose
    initials (D, I, K, R) come first.

    A row keeps its role (K), becomes user or assistant (R), or goes (D, which is a must for blank rows and duplicates of
    an earlier row); rows without text are put in anywhere (I). Costs go backward through the rows as a vector by state.
    A conversation lies in chunks of up to ``chunk`` rows, which run abreast from guessed vectors, are run again where
    the guess differs from the truth by more than a constant, and are then traced forward from each state in which they may
    begin; so no conversation is gathered, whatever its length, nor are the passes as many as its chunks.

    Rows are taken by turn, nulls first, then by role and text. A null role or text counts as a space; rows of a null
    conversation are one conversation. Repeated rows are duplicates. A role other than s, u, a is never kept. An empty table
    gives no rows; further columns are ignored.
    """
    bounded_batches(rows.sparkSession)
    rows = materialise(_faults(materialise(_ordered(rows, conv, turn, role, text))))
    chunks = materialise(_chunks(rows, chunk))
    bounds = _keyed(chunks, F.lit(True).alias("__there"))
    link = _beside(chunks.withColumn("to", F.col("at") + 1), bounds, "to", "left").withColumn("last", F.col("__there").isNull()).drop("to", "__there")
    link = _beside(link.withColumn("to", F.col("at") - 1), bounds, "to", "left").withColumn("lead", F.col("__there").isNull()).drop("to", "__there")
    link = materialise(link)
    end = F.array(*[F.lit(x).cast("long") for x in END])
    alone, linked = link.filter("last and lead").withColumn("seed", end), link.filter("not (last and lead)")
    if not linked.isEmpty():
        seeds = _keyed(_seeds(linked.drop("lead"), fixups), F.col("seed"))
        alone = alone.unionByName(_beside(linked, seeds, "at", "inner"))
    traced = materialise(alone.withColumn("t", _trace(F.col("codes"), F.col("seed"))))
    done = traced.filter("last and lead").withColumn("begin", F.lit(START))
    if not linked.isEmpty():
        done = done.unionByName(_begins(traced.filter("not (last and lead)")))
    done = materialise(done.select("conv", "at", "first", "last", "codes", *[F.element_at(F.col(f"t.{n}"), F.col("begin") + 1).alias(n) for n in ("ends", "costs", "edits")]))
    return Repair(_edits(rows, done), _report(rows, done))


def _edits(rows: DataFrame, done: DataFrame) -> DataFrame:
    table = lambda of: F.array(*[F.lit(of(o)) for o in _ALL])
    names = F.create_map(F.lit("u"), F.lit("user"), F.lit("a"), F.lit("assistant"))
    each = done.select("first", F.posexplode("edits").alias("i", "option")).select((F.col("first") + F.col("i")).alias("id"), F.col("option").cast("int").alias("option"))
    r = rows.drop("code", "part").join(each, "id")
    edits, roles = F.element_at(table(lambda o: o.edits), F.col("option") + 1), F.element_at(table(lambda o: o.roles), F.col("option") + 1)
    r = r.withColumn("__e", edits).withColumn("__r", roles)
    r = r.select("conv", "turn", "id", "role", "text", "fault", "__r", F.posexplode(F.split("__e", "")).alias("place", "edit")).filter("edit <> ''")
    own = names[F.substring("__r", F.col("place") + 1, F.lit(1))]
    new = r.edit == "I"
    changed = r.select(
        "conv", F.when(~new, F.col("turn")).alias("turn"), "id", "place", "edit", F.when(r.edit.isin("I", "R"), own).otherwise(F.col("role")).alias("role"),
        F.when(new, "").otherwise(F.col("text")).alias("text"), F.when(~new, F.col("fault")).alias("fault"),
    )
    ends = F.element_at(F.array(*[F.lit(e) for e in ENDINGS]), F.col("ends").cast("int") + 1)
    tail = done.filter("last").select("conv", (F.col("first") + F.size("codes") - 1).alias("id"), F.posexplode(F.split(ends, "")).alias("place", "__r")).filter("__r <> ''")
    none = F.lit(None)
    tail = tail.select("conv", none.cast(rows.schema["turn"].dataType).alias("turn"), "id", (F.col("place") + 9).alias("place"), F.lit("I").alias("edit"), names[F.col("__r")].alias("role"), F.lit("").alias("text"), none.cast("string").alias("fault"))
    return changed.unionByName(tail)


def _report(rows: DataFrame, done: DataFrame) -> DataFrame:
    """``(conv, n_rows, gaps, blank, duplicate, truncated, illegal, cost)``."""
    faults = [F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")]
    turns = F.try_subtract(F.try_add(F.try_subtract(F.max("turn"), F.min("turn")), F.lit(1).cast("long")), F.count_distinct("turn"))
    a = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("n_rows"), *faults, F.when(F.max("turn").isNull(), F.lit(0).cast("long")).otherwise(turns).alias("gaps"))
    role = lambda i: F.substring(F.lit(ROLES + "?"), F.element_at("codes", i).bitwiseAND(F.lit(3)) + 1, F.lit(1))
    seam = _beside(done.withColumn("to", F.col("at") + 1), _keyed(done, role(1).alias("__next")), "to", "left")
    bad = _illegal(F.col("codes")) + F.when(F.concat(role(-1), "__next").isin(*LEGAL) | F.col("__next").isNull(), 0).otherwise(1)
    closing = F.element_at(F.array(*[F.lit(x) for x in END]), F.col("ends").cast("int") + 1)
    c = seam.select(F.col("conv").alias("__conv"), bad.alias("illegal"), (F.col("costs") + F.when(F.col("last"), closing).otherwise(0)).alias("cost"))
    c = c.groupBy("__conv").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"))
    return a.join(c, F.col("conv").eqNullSafe(F.col("__conv"))).select("conv", "n_rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def audits(edits: DataFrame) -> DataFrame:
    """``(conv, audit, repaired_sha256)``: the edits' initials of each conversation in order, and the SHA-256 (hex) of the
    ``role:text`` of its rows after repair, newline-joined.

    A digest reads its rows one after the other, so those of a conversation go through one task; they are streamed there in
    batches, sorted before, and only the digest's state and the initials are held."""
    bounded_batches(edits.sparkSession)
    line = F.when(F.col("edit") != "D", F.concat_ws(":", "role", "text"))
    r = edits.select("conv", "id", "place", "edit", line.alias("line"))
    r = r.repartition(F.col("conv")).sortWithinPartitions(F.col("conv").asc_nulls_first(), "id", "place").select("conv", "edit", "line")
    kind = r.schema["conv"].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, initials, digest, empty, out = None, None, None, True, []
        schema = None

        def close() -> None:
            if digest is not None:
                out.append((now, "".join(initials), digest.hexdigest()))

        def flush() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], schema), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.string())], names=["conv", "audit", "repaired_sha256"])
            out.clear()
            return b

        for b in batches:
            schema = b.schema.field("conv").type
            for conv, edit, line in zip(*(b[c].to_pylist() for c in ("conv", "edit", "line")), strict=True):
                if digest is None or conv != now:
                    close()
                    now, initials, digest, empty = conv, [], hashlib.sha256(), True
                initials.append(edit)
                if line is not None:
                    digest.update((line if empty else "\n" + line).encode())
                    empty = False
            if out:
                yield flush()
        close()
        if out:
            yield flush()

    return r.mapInArrow(fold, f"conv {kind}, audit string, repaired_sha256 string")
