"""Fuzzy line dedup: MinHash over character shingles, banding, exact Jaccard, and one line kept per class."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from verdictlab.functions.shared import materialise
from verdictlab.llm.linking import classes, sieve
from verdictlab.llm.text import blocks, bounded_batches, byte_table, code_point_ends, list_array, mix

#: Characters of a shingle; least Jaccard similarity; bands and minima of a band.
SHINGLE, SIMILAR, BANDS, ROWS = 8, 0.8, 10, 3
_HASHES = BANDS * ROWS
_ODD = (mix(np.arange(1, _HASHES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_XOR = (mix(np.arange(501, _HASHES + 501, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
#: White space; bytes of UTF-8, folded, in which it is 0.
_BLANK = b"\0\t\n\x0b\x0c\r "
_FOLD = byte_table(_BLANK).tobytes()
#: Bytes of text, and pairs of lines, worked on at once: few enough for a processor's cache.
BLOCK, PAIRS = 1 << 16, 64
#: Digests that a task remembers, so as not to send the signature of a line again.
REMEMBERED = 1 << 19

LINES = "array<struct<no: int, start: int, end: int, digest: bigint, keys: array<bigint>, folded: string>>"


def _characters(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the places ``at`` among them."""
    if not len(data) or data.max() < 128:
        return data, at
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32), code_point_ends(data)[at]


def _split(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(folded bytes, document, number, start, end, first folded byte plus the end)`` of the lines that have
    a visible character; a line's end takes in its line feed. White space is left out of the folded bytes."""
    raw = data.tobytes()
    seen = np.frombuffer(raw.translate(_FOLD), np.uint8) != 0
    begin = np.union1d(np.flatnonzero(data == 10) + 1, offs[:-1])
    begin = begin[begin < len(data)]
    stop = np.concatenate((begin[1:], [len(data)])).astype(np.int64)
    doc = np.searchsorted(offs, begin, "right") - 1
    new = np.flatnonzero(np.diff(doc, prepend=-1))
    no = np.arange(len(begin)) - np.repeat(new, np.diff(np.append(new, len(begin))))
    size = np.add.reduceat(seen.view(np.uint8), begin, dtype=np.int64) if len(begin) else begin
    has = size > 0
    return np.frombuffer(raw.translate(_FOLD, _BLANK), np.uint8), doc[has], no[has], begin[has], stop[has], np.concatenate(([0], np.cumsum(size[has])))


def _hashes(c: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of folded lines laid end to end (``at``: first character of each plus the end); a line shorter
    than a shingle, but not empty, is one shingle. Returns (shingles of each line, hashes)."""
    size = np.diff(at)
    h, spare = np.zeros(len(c) + SHINGLE, np.uint64), np.empty(len(c) + SHINGLE, np.uint64)
    h[: len(c)] = c
    step, base = 1, 0x9E3779B97F4A7C15
    while step < SHINGLE:  # of 2, of 4, of 8 characters
        n = len(h) - step
        np.multiply(h[:n], np.uint64(base), out=spare[:n])
        np.add(spare[:n], h[step:], out=spare[:n])
        h, spare = spare[:n], h
        step, base = 2 * step, base * base % (1 << 64)
    first = np.ones(len(c), bool)  # of a shingle
    for i in range(1, SHINGLE):
        first[(at[1:] - i)[size > i]] = False
    short = np.flatnonzero((size < SHINGLE) & (size > 0))
    if len(short):
        y = size[short].astype(np.uint64)
        for i in range(SHINGLE - 1):
            more = size[short] > i
            y[more] = y[more] * np.uint64(0x9E3779B97F4A7C15) + c[at[short[more]] + i] + np.uint64(1)
        h[at[short]] = y
    x = h[: len(c)][first]
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x >>= np.uint64(32)
    return np.where(size < SHINGLE, np.minimum(size, 1), size - SHINGLE + 1), x.astype(np.uint32)


class _Lines:
    """Lines of each text: number, code-point offsets, digest of the folded line; and its band keys and folded
    characters, unless this task has just sent them: they are a function of the digest."""

    def __init__(self):
        self.sent: set[int] = set()

    def __call__(self, texts: pa.Array) -> pa.Array:
        cols: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(5)]
        sizes, least, fresh, folded = [np.zeros(0, np.int64)], [np.zeros((_HASHES, 0), np.uint32)], [np.zeros(0, bool)], [np.zeros(0, np.uint8)]
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:  # bytes that aren't UTF-8
            texts = pa.array([x if x is None else x.decode("utf-8", "replace") for x in texts.cast(pa.binary()).to_pylist()], pa.string())
        for _, data, offs in blocks(texts, BLOCK):
            f, doc, no, begin, stop, at = _split(data, offs)
            sizes.append(np.bincount(doc, minlength=len(offs) - 1))
            if not len(doc):
                continue
            size = np.diff(at)
            c, at = _characters(f, at)
            n, h = _hashes(c, at)
            first = np.cumsum(n) - n
            turn = mix(np.arange(int(n.max()), dtype=np.uint64)) | np.uint64(1)
            digest = np.add.reduceat(h * np.concatenate([turn[:x] for x in n.tolist()]), first)
            digest = mix(digest + np.diff(at).astype(np.uint64)).view(np.int64)
            new = np.zeros(len(digest), bool)
            new[np.unique(digest, return_index=True)[1]] = True
            new[new] = [x not in self.sent for x in digest[new].tolist()]
            fresh.append(new)
            if len(self.sent) > REMEMBERED:
                self.sent.clear()
            self.sent.update(digest[new].tolist())
            if not new.all():
                h, f = h[np.repeat(new, n)], f[np.repeat(new, size)]
                size, n = np.where(new, size, 0), n[new]
                first = np.cumsum(n) - n
            if len(n):
                low, x = np.empty((_HASHES, len(n)), np.uint32), np.empty_like(h)
                for i in range(_HASHES):
                    np.bitwise_xor(h, _XOR[i], out=x)
                    np.multiply(x, _ODD[i], out=x)
                    np.minimum.reduceat(x, first, out=low[i])
                least.append(low)
                folded.append(f)
            stop = stop - (data[stop - 1] == 10)
            if data.max() > 127:
                ends = code_point_ends(data)
                begin, stop, offs = ends[begin], ends[stop], ends[offs]
            base = offs[:-1][doc]
            for col, x in zip(cols, (no, begin - base, stop - base, digest, size), strict=True):
                col.append(x)
        no, start, end, digest, size = (np.concatenate(c) for c in cols)
        new = np.concatenate(fresh)
        low = np.concatenate(least, axis=1)
        bands = np.arange(BANDS, dtype=np.uint64)[:, None]
        for i in range(ROWS):
            bands = mix(bands + low[i::ROWS])
        ends = np.concatenate(([0], np.cumsum(BANDS * new)))
        keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bands.T.ravel().view(np.int64)), mask=pa.array(~new))
        ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
        text = pa.StringArray.from_buffers(len(new), pa.py_buffer(ends), pa.py_buffer(np.concatenate(folded)), pa.py_buffer(np.packbits(new, bitorder="little")))
        made = [pa.array(x.astype(np.int32)) for x in (no, start, end)] + [pa.array(digest), keys, text]
        return list_array(pa.StructArray.from_arrays(made, names=["no", "start", "end", "digest", "keys", "folded"]), np.concatenate(sizes))


def _shingles(folded: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row of each shingle, shingle hashes) of folded lines."""
    rows, hashes = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
    for row, data, offs in blocks(folded, BLOCK):
        n, h = _hashes(*_characters(data, offs))
        rows.append(np.repeat(np.arange(row, row + len(n), dtype=np.uint64), n))
        hashes.append(h)
    return np.concatenate(rows), np.concatenate(hashes)


def _tokens(folded: pa.Array) -> pa.Array:
    """The shingle set of each line as a list."""
    row, h = _shingles(folded)
    keys = np.sort(row << np.uint64(32) | h)
    keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    sizes = np.bincount((keys >> np.uint64(32)).astype(np.int64), minlength=len(folded))
    return list_array(pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)), sizes)


def _similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    """Exact Jaccard similarity of the shingle sets of two folded lines each. Both sets of some pairs are sorted at once, by row, hash
    and side; a hash of both sides is found beside itself."""
    out = [np.zeros(0)]
    for at in range(0, len(a), PAIRS):
        n = min(PAIRS, len(a) - at)
        keys = []
        for side, x in enumerate((a, b)):
            row, h = _shingles(x.slice(at, PAIRS))
            keys.append((row << np.uint64(33)) + (h.astype(np.uint64) << np.uint64(1)) + np.uint64(side))
        k = np.sort(np.concatenate(keys))
        k = k[np.append(True, k[1:] != k[:-1])] if len(k) else k
        twice = k[1:][(k[1:] ^ k[:-1]) == 1]
        rows = np.arange(n + 1, dtype=np.uint64) << np.uint64(33)
        every, both = (np.diff(np.searchsorted(x, rows)) for x in (k, twice))
        out.append(both / (every - both))
    return pa.array(np.concatenate(out))


def fuzzy_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", similar: float = SIMILAR) -> DataFrame:
    """``(key, text_hash, line_no, start, end, kept_key, kept_text_hash, kept_line_no, is_kept)``, one row per line that
    has a visible character.

    Lines are folded (A-Z lower, no white space) and shingled by eight characters. Lines of one class, linked by a
    Jaccard similarity of ``similar`` or more of their shingle sets, keep the line of the smallest key, then
    ``text_hash``, then number: it is named in each row and stands for the class. Equal folded lines are one line from
    the start. Offsets are code points of the original text, the line feed left out.

    Keys are integers; rows with a null key are left out. Rows of one key with different texts are documents of their
    own, told apart by ``text_hash``; repeated rows of one key and text count once. Null and empty texts have no lines;
    an empty table gives no rows; other columns aren't read.
    """
    bounded_batches(docs.sparkSession)
    lines = F.arrow_udf(_lines(), LINES).asNondeterministic()
    rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.xxhash64(F.col(text)).alias("h"), lines(F.col(text)).alias("l"))
    rows = materialise(rows.select("doc", "h", F.inline("l")))
    slim = rows.select("doc", "h", "no", "start", "end", "digest")
    sent = rows.filter("keys is not null")
    signatures = sent.select(F.col("digest").alias("id"), "keys")

    def prepare(ids: DataFrame):
        may, _ = sieve(ids.select(F.col("id").alias("x")))
        v = materialise(sent.filter(may("digest")).select(F.col("digest").alias("id"), F.col("folded").alias("x")).join(ids.hint("merge"), "id").dropDuplicates(["id"]))
        similarity = F.arrow_udf(_similarity, "double").asNondeterministic()

        def score(pairs: DataFrame) -> DataFrame:
            p = pairs.join(v.select(F.col("id").alias("b"), F.col("x").alias("y")), "b").join(v.withColumnRenamed("id", "a"), "a")
            return p.withColumn("s", similarity("x", "y")).filter(F.col("s") >= 2 * similar - 1).select("a", "b", "s")

        toks = F.arrow_udf(_tokens, "array<bigint>").asNondeterministic()
        return score, lambda ids: v.join(ids, "id").select("id", toks("x").alias("toks"))

    found = classes(signatures, prepare, similar)
    this = F.struct("doc", "h", "no")
    # most lines stand once and have no partner: only the digests of the others are looked up, and only their lines shuffled
    again = slim.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("digest").alias("x"))
    may, _ = sieve(again.unionByName(found.select(F.col("id").alias("x"))))
    some = materialise(slim.filter(may("digest")).dropDuplicates(["doc", "h", "no"]))
    named = some.groupBy("digest").agg(F.min(this).alias("first")).join(found, F.col("digest") == F.col("id"), "left")
    named = materialise(named.select("digest", F.coalesce("class", "digest").alias("class"), "first"))
    keep = named.groupBy("class").agg(F.min("first").alias("keep"))
    named = named.join(keep, "class").select("digest", "keep")
    out = slim.filter(~may("digest")).withColumn("keep", this).unionByName(some.join(named, "digest"))
    return out.select(
        F.col("doc").alias(key), F.col("h").alias("text_hash"), F.col("no").alias("line_no"), "start", "end",
        F.col("keep.doc").alias(f"kept_{key}"), F.col("keep.h").alias("kept_text_hash"), F.col("keep.no").alias("kept_line_no"),
        (this == F.col("keep")).alias("is_kept"),
    )


def _lines():
    """A function for one task each: what it remembers begins anew there."""
    state = {}

    def lines(texts: pa.Array) -> pa.Array:
        return state.setdefault("lines", _Lines())(texts)

    return lines


def remove_lines(docs: DataFrame, lines: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` without the lines that aren't kept in ``lines`` (of ``fuzzy_lines``); other documents stay as they are."""
    gone = lines.filter(~F.col("is_kept")).groupBy(F.col(key).alias("__id"), F.col("text_hash").alias("__h")).agg(F.collect_set("line_no").alias("__gone"))
    d = docs.join(gone, (F.col(key).cast("long") == F.col("__id")) & (F.xxhash64(F.col(text)) == F.col("__h")), "left")
    left = F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains(F.col("__gone"), i))
    return d.withColumn(text, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(left, "\n"))).drop("__id", "__h", "__gone")
