"""Substring dedup by line hashing: repeated lines by their digests, and repeated passages inside lines by seeds."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from verdictlab.functions.shared import materialise
from verdictlab.llm.text import blocks, bounded_batches, code_point_ends, list_array, mix, words

#: Words of a seed: the shortest repeat inside a line that is taken out.
SEED = 17
#: Words of the passages that can't be missed: of any so many consecutive words, at least one seed is chosen.
PASSAGE = 50
#: Code points on either side of a run of seeds that are read first; a run that isn't at its end there gets ``WIDER`` times
#: as many, and so on.
MARGIN, WIDER = 600, 16
#: A digest with more than this part of all occurrences is hot; so at most 10,000 digests are.
HOT = 1e-4

UNITS = "array<struct<line: boolean, at: int, n: int, start: int, end: int, digest: bigint>>"
RUNS = "struct<open: boolean, runs: array<struct<at: int, n: int, start: int, end: int, first_start: int>>>"


def _runs_of(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive values, by doubling."""
    part, size, out, done = h, 1, None, 0
    while True:
        if k & size:
            if out is None:
                out, done = part, size
            else:
                n = len(h) - done - size + 1
                out, done = mix(out[:n] * np.uint64(0x100000001B3) + part[done : done + n]), done + size
        if done == k:
            return out
        part, size = mix(part[:-size] * np.uint64(0x100000001B3) + part[size:]), 2 * size


def seeds(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(first word, digest)`` of the chosen seeds: in every ``PASSAGE`` consecutive words of a document, the seed of
    the smallest hash. So equal passages choose equal seeds, wherever they stand."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(h) < PASSAGE:
        return none
    g = _runs_of(h, SEED)
    # hash in the upper bits, and in the lower ones the place, falling, so that the last of equal ones is smallest
    low = np.uint64((1 << 24) - 1)
    key = (g & ~low) | (low - (np.arange(len(g), dtype=np.uint64) & low))
    width = PASSAGE - SEED + 1
    size = 1
    while 2 * size <= width:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    n = len(g) - width + 1
    key = np.minimum(key[:n], key[width - size : width - size + n])
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    key, at = key[doc[:n] == doc[PASSAGE - 1 : PASSAGE - 1 + n]], np.flatnonzero(doc[:n] == doc[PASSAGE - 1 : PASSAGE - 1 + n])
    if not len(at):
        return none
    at = at + ((low - (key & low)).astype(np.int64) - at & int(low))
    at = at[np.concatenate(([True], at[1:] != at[:-1]))]
    # of equal seeds in a row (words over and over), the first and last of each stretch of a window's width will do
    new = np.concatenate(([True], (g[at[1:]] != g[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]])))
    run = np.cumsum(new) - 1
    stretch = (at - at[new][run]) // width
    edge = np.concatenate(([True], (run[1:] != run[:-1]) | (stretch[1:] != stretch[:-1]), [True]))
    at = at[edge[:-1] | edge[1:]]
    return at, g[at]


def _units(texts: pa.Array) -> pa.Array:
    """Per text: number of words and digest of all of them, and the lines and seeds with word and code-point offsets."""
    cols: list[list[np.ndarray]] = [[] for _ in range(6)]
    sizes, counts, digests = [], [], []
    for _, data, offs in blocks(texts):
        first, start, end, h = words(data, offs)
        n_docs = len(offs) - 1
        counts.append(np.diff(first))
        if not len(h):
            sizes.append(np.zeros(n_docs, np.int64))
            digests.append(np.zeros(n_docs, np.uint64))
            continue

        def digest(begin, stop, salt):
            n = stop - begin
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            own = h[np.repeat(begin, n) + place] * (mix(place.astype(np.uint64)) | np.uint64(1))
            return mix(np.add.reduceat(own, np.cumsum(n) - n) + n.astype(np.uint64) + np.uint64(salt))

        full = np.diff(first) > 0
        whole = np.zeros(n_docs, np.uint64)
        whole[full] = digest(first[:-1][full], first[1:][full], 1 << 40)
        digests.append(whole)
        lines = np.concatenate(([0], np.cumsum(data == 10)))
        cut = np.zeros(len(h), bool)
        cut[:-1] = lines[start[1:]] > lines[end[:-1]]
        cut[first[1:][full] - 1] = True
        stop = np.flatnonzero(cut) + 1
        begin = np.concatenate(([0], stop[:-1]))
        at, found = seeds(h, first)
        begin, stop, digest_of = np.concatenate((begin, at)), np.concatenate((stop, at + SEED)), np.concatenate((digest(begin, stop, 0), mix(found + np.uint64(SEED))))
        is_line = np.arange(len(begin)) < len(begin) - len(at)
        doc = np.searchsorted(first, begin, "right") - 1
        order = np.argsort(doc, kind="stable")
        begin, stop, digest_of, is_line, doc = begin[order], stop[order], digest_of[order], is_line[order], doc[order]
        points = code_point_ends(data)
        base = points[offs[:-1]][doc]
        for col, x in zip(cols, (is_line, begin - first[doc], stop - begin, points[start[begin]] - base, points[end[stop - 1]] - base, digest_of.view(np.int64)), strict=True):
            col.append(x)
        sizes.append(np.bincount(doc, minlength=n_docs))
    flat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols]
    kinds = (pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
    units = pa.StructArray.from_arrays([pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(flat, kinds, strict=True)], names=["line", "at", "n", "start", "end", "digest"])
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    made = [pa.array(join(counts, np.int64), pa.int64()), pa.array(join(digests, np.uint64).view(np.int64)), list_array(units, join(sizes, np.int64))]
    return pa.StructArray.from_arrays(made, names=["n_words", "digest", "units"])


class _Slice:
    """The words of a piece of a text that begins at code point ``offset``: hashes and code-point offsets."""

    def __init__(self, text: str, offset: int):
        data = np.frombuffer(text.encode(), np.uint8)
        _, start, end, self.hash = words(data, np.array([0, len(data)]))
        points = code_point_ends(data) + offset
        self.start, self.end = points[start], points[end]
        # a word at the margin may be the rest of a longer one
        self.low, self.high = int(offset > 0), len(self.hash)


def _equal(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning."""
    n, done, size = min(len(a), len(b)), 0, 32
    while done < n:
        off = np.flatnonzero(a[done : min(done + size, n)] != b[done : min(done + size, n)])
        if len(off):
            return done + int(off[0])
        done, size = done + size, 2 * size
    return n


def _extend(text: str, at: int, more: bool, first: str, first_at: int, first_more: bool, pairs: list[dict]) -> dict:
    """The maximal runs of equal words around the seeds (``start`` in the text, ``first`` in the original) inside the
    two pieces, which begin at code points ``at`` and ``first_at``; ``more`` tells that the text goes on behind. ``open``
    tells that a run ends where a piece does, so that it may be longer."""
    a, b = _Slice(text, at), _Slice(first, first_at)
    a.high -= more
    b.high -= first_more
    x = np.searchsorted(a.start, [p["start"] for p in pairs])
    y = np.searchsorted(b.start, [p["first"] for p in pairs])
    base = np.array([p["at"] for p in pairs]) - x
    out, until, open_ = [], -1, False
    for k in np.lexsort((y, x)):
        i, j = int(x[k]), int(y[k])
        if i + SEED <= until:  # inside a run already
            continue
        if i < a.low or j < b.low or i + SEED > a.high or j + SEED > b.high:  # words longer than the margin
            open_ = True
            continue
        back = _equal(a.hash[a.low : i][::-1], b.hash[b.low : j][::-1])
        ahead = _equal(a.hash[i : a.high], b.hash[j : b.high])
        if ahead < SEED:  # two seeds of one digest, but other words
            continue
        until = max(until, i + ahead)
        open_ |= (i - back == a.low > 0) or (j - back == b.low > 0) or (more and i + ahead == a.high) or (first_more and j + ahead == b.high)
        out.append({"at": int(base[k]) + i - back, "n": back + ahead, "start": int(a.start[i - back]), "end": int(a.end[i + ahead - 1]), "first_start": int(b.start[j - back])})
    return {"open": open_, "runs": out}


def _extended(texts: pa.Array, ats: pa.Array, mores: pa.Array, firsts: pa.Array, first_ats: pa.Array, first_mores: pa.Array, pairs: pa.Array) -> pa.Array:
    rows = zip(texts, ats, mores, firsts, first_ats, first_mores, pairs, strict=True)
    kind = pa.list_(pa.struct([(n, pa.int32()) for n in ("at", "n", "start", "end", "first_start")]))
    return pa.array([_extend(*(x.as_py() for x in r)) for r in rows], pa.struct([("open", pa.bool_()), ("runs", kind)]))


def _firsts(e: DataFrame, rank: list[str]) -> DataFrame:
    """``e`` without the first of each digest, the others with the struct ``first`` of its ``rank`` columns. Digests
    are pre-aggregated; hot ones (a bounded number) are joined by broadcast, so no task gets all rows of a digest."""
    own = F.struct(*rank)
    first = e.groupBy("digest").agg(F.min(own).alias("first"), F.max(own).alias("last"), F.count(F.lit(1)).alias("many"))
    first = materialise(first.filter("first <> last").select("digest", "first", "many"))
    hot = first.filter(F.col("many") > HOT * e.count())  # fewer than 1 / HOT rows, whatever the input
    hot = hot.select("digest", F.col("first").alias("hot"))
    marked = e.join(F.broadcast(hot), "digest", "left")
    rest = marked.filter("hot is null").drop("hot").join(first.drop("many"), "digest")
    return marked.filter("hot is not null").withColumnRenamed("hot", "first").unionByName(rest).filter(own != F.col("first"))


def repeated_spans(docs: DataFrame, text: str = "text", key: str = "doc_id", min_line_words: int = 1, passages: bool = True) -> DataFrame:
    """``(key, text_hash, start, end, n_words, kind, first_key, first_start)``: what stands earlier already.

    Units are whole texts and whole lines, normalised to words (A-Z lower, no punctuation); their digests are grouped
    over all documents. Of equal units the one of the smallest key (then of the smallest ``text_hash``), then the
    first in its text, is kept; all others are repeats, of any length, or lines from ``min_line_words`` words on.
    With ``passages``, repeats inside lines and across them are found too: seeds of ``SEED`` consecutive words,
    chosen so that any ``PASSAGE`` consecutive words hold one, are grouped likewise, and each repeated seed is
    extended word by word along the text in which its first occurrence stands. So each span of a passage is a run of
    at least ``SEED`` words that stands earlier, and no ``PASSAGE`` consecutive words that stand earlier in a text
    are without a span.

    Overlapping repeats of a text are one span. ``kind`` is ``text``, ``line`` or ``passage`` by its first part.
    Offsets are code points of the original text, the end exclusive; ``first_key`` and ``first_start`` tell where the
    original of that part stands.

    Keys are integers; rows with a null key are left out. Rows of one key with different texts are documents of their
    own, told apart by ``text_hash``; repeated rows of one key and text count once. Null, empty and wordless texts have
    no units. An empty table gives no rows; other columns aren't read.
    """
    bounded_batches(docs.sparkSession)
    source = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("t"))
    units = F.arrow_udf(_units, f"struct<n_words: bigint, digest: bigint, units: {UNITS}>").asNondeterministic()
    base = materialise(source.withColumn("u", units("t")).select("id", "h", "u.*").filter("n_words > 0"))
    twice = materialise(base.groupBy("id", "h").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("id", "h"))
    if not twice.isEmpty():  # repeated rows of one key and text count once
        base = base.join(twice, ["id", "h"], "left_anti").unionByName(base.join(twice, ["id", "h"], "left_semi").dropDuplicates(["id", "h"]))

    # whole texts first: a copy has no unit of its own that isn't in its original
    copies = materialise(_firsts(base.select("id", "h", "digest"), ["id", "h"]).select("id", "h", "first"))
    ends = F.array_max(F.transform("units", lambda x: x["end"])).alias("end")
    starts = F.array_min(F.transform("units", lambda x: x["start"])).alias("start")
    found = base.select("id", "h", F.col("n_words").cast("int").alias("n"), starts, ends).join(copies, ["id", "h"]).select(
        "id", "h", F.lit(0).alias("at"), "n", "start", "end", F.lit("text").alias("kind"), F.col("first.id").alias("first_id"), F.lit(0).alias("first_start")
    )
    e = base.join(copies, ["id", "h"], "left_anti").select("id", "h", F.inline("units"))
    e = materialise(e.filter(F.col("line") & (F.col("n") >= min_line_words) | (F.lit(passages) & ~F.col("line"))))
    again = materialise(_firsts(e, ["id", "h", "at", "start"]))
    found = found.unionByName(again.filter("line").select(
        "id", "h", "at", "n", "start", "end", F.lit("line").alias("kind"), F.col("first.id").alias("first_id"), F.col("first.start").alias("first_start")
    ))
    if passages:
        found = found.unionByName(_passages(source, again.filter("not line")))
    # islands of overlapping spans
    by = Window.partitionBy("id", "h").orderBy("start", F.col("end").desc(), "kind", "first_id", "first_start")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int")
    island = F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0))
    found = found.withColumn("new", new).withColumn("island", island)
    head = F.max_by(F.struct("kind", "first_id", "first_start"), "new")
    return found.groupBy("id", "h", "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), (F.max(F.col("at") + F.col("n")) - F.min("at")).cast("long").alias("n_words"), head.alias("x")
    ).select(F.col("id").alias(key), F.col("h").alias("text_hash"), "start", "end", "n_words", "x.kind", F.col("x.first_id").alias(f"first_{key}"), F.col("x.first_start").alias("first_start"))


def _passages(source: DataFrame, again: DataFrame) -> DataFrame:
    """Runs of equal words around the repeated seeds ``again``. Only pieces of the two texts travel: from ``MARGIN``
    before the first of the seeds that a text shares with an original to ``MARGIN`` behind the last. Where a run goes on to
    the end of a piece, wider pieces are cut, until words differ or the texts end."""
    pairs = again.groupBy("id", "h", F.col("first.id").alias("fid"), F.col("first.h").alias("fh")).agg(
        F.min("start").alias("low"), F.max("end").alias("high"), F.min("first.start").alias("flow"),
        F.max(F.col("first.start") + F.col("end") - F.col("start")).alias("fhigh"),
        F.collect_list(F.struct("at", "start", F.col("first.start").alias("first"))).alias("pairs"),
    )
    one = source.join(again.select("id", "h").unionByName(again.select("first.id", "first.h")).distinct(), ["id", "h"], "left_semi")
    one = materialise(one.dropDuplicates(["id", "h"]))
    extended = F.arrow_udf(_extended, RUNS).asNondeterministic()
    of = pairs.columns

    def piece(p: DataFrame, margin: int, low: str, high: str, name: str) -> DataFrame:
        at = F.greatest(F.col(low) - margin, F.lit(0))
        p = p.withColumn(f"{name}_at", at).withColumn(f"{name}_more", F.length("t") > F.col(high) + margin)
        return p.withColumn(name, F.substring("t", at + 1, F.col(high) + margin - at)).drop("t")

    margin, done = MARGIN, []
    while True:
        # the texts grow with the documents, so these are sort-merge joins at every size
        p = piece(pairs.join(one.hint("merge"), ["id", "h"]), margin, "low", "high", "a")
        p = piece(p.join(one.select(F.col("id").alias("fid"), F.col("h").alias("fh"), "t").hint("merge"), ["fid", "fh"]), margin, "flow", "fhigh", "b")
        p = p.withColumn("x", extended("a", "a_at", "a_more", "b", "b_at", "b_more", "pairs"))
        p = materialise(p.select(*of[:-1], "x.open", F.when(~F.col("x.open"), F.col("x.runs")).alias("runs"), F.when(F.col("x.open"), F.col("pairs")).alias("pairs")))
        done.append(p.filter("not open").select("id", "h", "fid", F.inline("runs")))
        pairs = p.filter("open").select(*of)
        if pairs.isEmpty():
            break
        margin = min(margin * WIDER, 1 << 30)
        left = pairs.select("id", "h").unionByName(pairs.select(F.col("fid").alias("id"), F.col("fh").alias("h"))).distinct()
        one = materialise(one.join(left.hint("merge"), ["id", "h"], "left_semi"))
    p = reduce(DataFrame.unionByName, done)
    return p.select("id", "h", "at", "n", "start", "end", F.lit("passage").alias("kind"), F.col("fid").alias("first_id"), "first_start")


def remove_spans(docs: DataFrame, spans: DataFrame, text: str = "text", key: str = "doc_id", out: str = "removed_spans") -> DataFrame:
    """``docs`` without the spans of ``repeated_spans``; the array column ``out`` keeps their original offsets.
    Documents without a span stay as they are. Repeated rows of one key and text lose the same spans."""
    own = spans.groupBy(F.col(key).alias("__id"), F.col("text_hash").alias("__h")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__spans"))
    d = docs.drop(out).join(own, (F.col(key).cast("long") == F.col("__id")) & (F.xxhash64(F.col(text)) == F.col("__h")), "left")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("t"))
    cut = F.aggregate(
        "__spans", start,
        lambda acc, x: F.struct(x["end"].alias("at"), F.array_append(acc["t"], F.substring(F.col(text), acc["at"] + 1, x["start"] - acc["at"])).alias("t")),
        lambda acc: F.concat(F.array_join(acc["t"], ""), F.substring(F.col(text), acc["at"] + 1, F.length(F.col(text)))),
    )
    none = F.array().cast("array<struct<start: int, end: int>>")
    return d.withColumn(text, F.when(F.col("__spans").isNull(), F.col(text)).otherwise(cut)).withColumn(out, F.coalesce("__spans", none)).drop("__id", "__h", "__spans")
