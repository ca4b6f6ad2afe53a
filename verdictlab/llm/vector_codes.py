"""Vector codes: each part of a vector becomes the number of its nearest codebook entry, found along a trie of the parts."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from verdictlab.functions.shared import materialise
from verdictlab.llm.text import bounded_batches

#: Components are scaled and floored to integers; what lies beyond the bound counts as the bound, so that all sums of
#: squares are exact in 64 bits.
SCALE, BOUND = 1024, 1 << 24

#: Leaves of a trie that are walked level by level at once, and the nodes of its inner levels, are at most so many.
LEAVES = 512


@dataclass
class Codebooks:
    """Integer entries by part: ``entries[part][entry][position]``. Bounded by its shape, so it may be broadcast."""

    entries: list[np.ndarray]

    def digest(self) -> str:
        """SHA-256 (hex) of all components by part, entry and position, comma-joined."""
        return hashlib.sha256(",".join(str(x) for e in self.entries for x in e.ravel().tolist()).encode()).hexdigest()


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(entry, squared distance)`` of each of the distinct ``parts``, which are sorted lexicographically; ties go to the
    lower entry.

    The sorted parts are the leaves of a trie with a level per dimension. A node has the squared distances to all entries
    over the dimensions so far; its children add theirs to it, so a common prefix is summed once. The walk is depth-first:
    a node with more than ``LEAVES`` leaves is opened child by child; the subtree of a smaller one is walked level by
    level. So a walk holds one vector for each dimension, and those of ``LEAVES`` nodes.
    """
    n, dims = parts.shape
    code, error = np.zeros(n, np.int64), np.zeros(n, np.int64)
    stack = [(0, n, 0, np.zeros(len(entries), np.int64))] if n else []
    while stack:
        a, b, depth, sums = stack.pop()
        if b - a > LEAVES and depth < dims:
            column = parts[a:b, depth]
            cut = [a, *(np.flatnonzero(np.diff(column)) + a + 1).tolist(), b]
            cut = _groups(cut, LEAVES)  # small neighbours together, with the sums of their parent
            for x, y in zip(cut[-2::-1], cut[:0:-1], strict=True):
                if parts[x, depth] == parts[y - 1, depth]:
                    stack.append((x, y, depth + 1, sums + (parts[x, depth] - entries[:, depth]) ** 2))
                else:
                    stack.append((x, y, depth, sums))
            continue
        own = parts[a:b]
        node, acc = np.zeros(b - a, np.int64), sums[None, :]
        new = np.zeros(b - a, bool)
        new[:1] = True
        for d in range(depth, dims):
            new[1:] |= own[1:, d] != own[:-1, d]
            at = np.flatnonzero(new)
            acc = acc[node[at]] + (own[at, d][:, None] - entries[None, :, d]) ** 2
            node = np.cumsum(new) - 1
        best = acc.argmin(axis=1)
        code[a:b], error[a:b] = best[node], acc[np.arange(len(acc)), best][node]
    return code, error


def _groups(cut: list[int], most: int) -> list[int]:
    """Fewer cuts: neighbours are put together as long as they have ``most`` leaves at most."""
    out = cut[:1]
    for x, y in zip(cut[1:-1], cut[2:], strict=True):
        if y - out[-1] > most:
            out.append(x)
    return [*out, cut[-1]]


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(-1, dims)


def integers(vector: Column) -> Column:
    """The components, scaled and floored, as longs between the bounds."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(BOUND))), F.lit(float(-BOUND)))).cast("long"))


def usable(vector: Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    inf = float("inf")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(inf)))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine, F.lit(False))


def parts_of(rows: DataFrame, n_parts: int, n_entries: int, key: str, vector: str) -> tuple[DataFrame, Codebooks, int]:
    """``(rows that can be coded with their integers in __v, first codebooks, dimensions of a part)``."""
    v = rows.filter(usable(F.col(vector))).withColumn("__v", integers(F.col(vector)))
    seeds = v.select(key, "__v").filter(F.col(key).isNotNull() & (F.size("__v") % n_parts == 0)).orderBy(key, "__v")
    size = next((len(r["__v"]) for r in seeds.take(1)), 0)
    first = [r["__v"] for r in seeds.filter(F.size("__v") == size).take(n_entries)] if size else []
    return v.filter(F.size("__v") == size), Codebooks(np.split(np.array(first, np.int64), n_parts, axis=1) if size else []), size // n_parts


def train(rows: DataFrame, n_parts: int = 4, n_entries: int = 256, rounds: int = 4, key: str = "vec_id", vector: str = "embedding") -> Codebooks:
    """Codebooks of integer entries: the parts of the first vectors by key, improved in ``rounds`` of assignment and
    floored means over all vectors.

    Equal parts are counted first, all over the table, and written once in lexicographic order; each round walks the tries of
    their range partitions and returns, by partition, a weighted sum and count for each entry. Only sums by entry reach the
    driver. Vectors that are null, empty or hold a null or non-finite component are left out, as are those of another
    length than the first one's, or whose length can't be cut into equal parts; rows without a key aren't seeds but
    count. With fewer rows than entries there are fewer entries; without rows there are none.
    """
    v, books, dims = parts_of(rows, n_parts, n_entries, key, vector)
    if not books.entries:
        return books
    cut = F.transform(F.sequence(F.lit(0), F.lit(n_parts - 1)), lambda i: F.struct(i.alias("part"), F.slice("__v", i * dims + 1, F.lit(dims)).alias("x")))
    distinct = v.select(F.explode(cut).alias("p")).groupBy("p.part", "p.x").agg(F.count(F.lit(1)).alias("n"))
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    distinct = materialise(distinct.repartitionByRange(spread, "part", "x").sortWithinPartitions("part", "x"))
    for _ in range(rounds):
        books = _better(distinct, books, dims)
    return books


def _better(distinct: DataFrame, books: Codebooks, dims: int) -> Codebooks:
    spark = distinct.sparkSession
    shared = spark.sparkContext.broadcast(books.entries)

    def walk(batches):
        entries = shared.value
        sums = [np.zeros((len(e), dims + 1), object) for e in entries]
        for b in batches:
            part, n = b["part"].to_numpy(), b["n"].to_numpy()
            x = _matrix(b["x"], dims)
            for p in np.unique(part).tolist():
                own = np.flatnonzero(part == p)
                code, _ = nearest(x[own], entries[p])
                at = np.argsort(code, kind="stable")
                cut = np.flatnonzero(np.diff(code[at], prepend=-1))
                weighted = np.column_stack((x[own], np.ones(len(own), np.int64))) * n[own][:, None]
                sums[p][code[at][cut]] += np.add.reduceat(weighted[at], cut).astype(object)
        rows = [(p, i, s) for p, e in enumerate(sums) for i, s in enumerate(e.tolist()) if s[-1]]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([[str(x) for x in r[2]] for r in rows], pa.list_(pa.string()))], names=["part", "entry", "s"])

    found = distinct.select("part", "x", "n").mapInArrow(walk, "part int, entry int, s array<string>")
    sums = found.groupBy("part", "entry").agg(*[F.sum(F.col("s")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims + 1)])
    new = [e.copy() for e in books.entries]
    for r in sums.collect():
        new[r["part"]][r["entry"]] = [int(r[f"s{i}"]) // int(r[f"s{dims}"]) for i in range(dims)]
    shared.destroy()
    return Codebooks(new)


def encode(rows: DataFrame, books: Codebooks, vector: str = "embedding", out: str = "vector_code") -> DataFrame:
    """The rows that can be coded, with the struct column ``out`` (it replaces a column of that name) of ``code`` (an entry's
    number by part) and ``error`` (squared distances summed over the parts).

    The codebooks are final, so each batch of rows is coded by itself along the tries of its own distinct parts, without a
    shuffle. Rows are left out as in ``train``; all others pass through with all their columns, repeated rows as often
    as they stand there. Without codebooks there are no rows.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    size = sum(e.shape[1] for e in books.entries)
    shared = spark.sparkContext.broadcast(books.entries)

    @F.arrow_udf("struct<code: array<int>, error: bigint>")
    def code(vectors: pa.Array) -> pa.Array:
        entries = shared.value
        x = _matrix(vectors, size)
        codes, errors, at = [], np.zeros(len(x), np.int64), 0
        for e in entries:
            own, back = np.unique(x[:, at : at + e.shape[1]], axis=0, return_inverse=True)
            c, d = nearest(own, e)
            codes.append(c[back.ravel()])
            errors += d[back.ravel()]
            at += e.shape[1]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(entries), pa.int32()), pa.array(np.column_stack(codes).ravel(), pa.int32()))
        return pa.StructArray.from_arrays([lists, pa.array(errors)], names=["code", "error"])

    fine = F.when(usable(F.col(vector)), F.size(vector)) == size if size else F.lit(False)
    return rows.filter(fine).withColumn(out, code.asNondeterministic()(integers(F.col(vector))))


def hex_code(code: Column) -> Column:
    """Two hex digits a part."""
    return F.lower(F.array_join(F.transform(code, lambda c: F.lpad(F.hex(c), 2, "0")), ""))


def decode(coded: DataFrame, books: Codebooks, out: str = "approximation", code: str = "vector_code") -> DataFrame:
    """``coded`` with the vector that its code stands for: the middles of the entries' cells, on the scale of the vectors."""
    shared = coded.sparkSession.sparkContext.broadcast(books.entries)

    @F.arrow_udf("array<double>")
    def middles(codes: pa.Array) -> pa.Array:
        c = _matrix(codes, len(shared.value))
        x = (np.concatenate([e[c[:, p]] for p, e in enumerate(shared.value)], axis=1) + 0.5) / SCALE
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))

    return coded.withColumn(out, middles(F.col(code)["code"]))


def label_errors(coded: DataFrame, label: str = "label", error: str = "error", out: str = "label_error") -> DataFrame:
    """``coded`` with the sum of ``error`` over all rows of an equal label, nulls together (null where it is no long).
    Labels are summed before they are shuffled, and joined back; a hot label is split by the join."""
    sums = coded.groupBy(F.col(label).alias("__l")).agg(F.try_sum(error).alias(out))
    return coded.drop(out).join(sums, F.col(label).eqNullSafe(F.col("__l")), "left").drop("__l")
