"""Vectorised text helpers for Arrow batches: blocks of documents, words and their hashes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of text worked on at once; a longer document is a block of its own.
BLOCK_BYTES = 1 << 20

#: Rows and bytes of an Arrow batch at most: they bound what a Python worker, and the JVM beside it, hold of long texts.
BATCH_ROWS, BATCH_BYTES = 1000, 1 << 23


def bounded_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by ``BATCH_ROWS`` and ``BATCH_BYTES`` (one longer text is a batch of its own),
    unless they are smaller already. The settings count when a plan runs, which is after an operator has returned, so
    they stay."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = re.fullmatch(r"(-?\d+)b?", str(spark.conf.get(name)).lower())
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(name, most)


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x + _STEP
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def byte_table(separators: bytes, lower: bool = True) -> np.ndarray:
    """A translation table: separators become 0, A-Z become a-z, all else stays."""
    t = np.arange(256, dtype=np.uint8)
    if lower:
        t[65:91] += 32
    t[list(separators)] = 0
    return t


#: Words are runs of ASCII letters, digits and all non-ASCII characters, in lower case.
WORD_TABLE = byte_table(bytes(i for i in range(128) if not (48 <= i < 58 or 65 <= i < 91 or 97 <= i < 123)))


def blocks(texts: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, offsets)`` of consecutive rows; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        yield i, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def words(data: np.ndarray, offs: np.ndarray, table: np.ndarray = WORD_TABLE) -> tuple[np.ndarray, ...]:
    """``(first word of each document plus the end, start, end, 64-bit hash)`` of the words of a block."""
    c = table[data]
    is_word = c != 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    before = np.zeros(len(data), bool)
    before[1:] = is_word[:-1]
    start = np.flatnonzero(is_word & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = is_word[1:]
    end = np.flatnonzero(is_word & (~after | edge[1:])) + 1
    if not len(start):
        return np.zeros(len(offs), np.int64), start, end, np.zeros(0, np.uint64)
    size = end - start
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    low, high = _powers(_BASE, 1 << 16), _powers(_powers(_BASE, (1 << 16) + 1)[-1], (int(size.max()) >> 16) + 1)
    letters = c[is_word]
    h = np.zeros(len(start), np.uint64)
    # in pieces, for eight-byte numbers of a whole long text would take many times its size
    for p in range(0, len(letters), BLOCK_BYTES):
        q = min(p + BLOCK_BYTES, len(letters))
        a, b = int(np.searchsorted(first, p, "right")) - 1, int(np.searchsorted(first, q, "left"))
        begin = np.maximum(first[a:b], p)
        place = np.arange(p, q) - np.repeat(first[a:b], np.diff(np.append(begin, q)))
        h[a:b] += np.add.reduceat(letters[p:q].astype(np.uint64) * low[place & 0xFFFF] * high[place >> 16], begin - p)
    return np.searchsorted(start, offs), start, end, mix(h + size.astype(np.uint64) * _STEP)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = base
    return np.multiply.accumulate(out)


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(first shingle of each document plus the end, hash)``: every k consecutive words of a document;
    a document of fewer words, but not none, has one shingle of all of them."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    at = np.concatenate(([0], np.cumsum(count)))
    doc = np.repeat(np.arange(len(n)), count)
    start = first[:-1][doc] + np.arange(at[-1]) - at[:-1][doc]
    last = first[1:][doc]
    out = np.zeros(len(start), np.uint64)
    pad = np.concatenate((h, np.zeros(k, np.uint64)))
    for i in range(k):
        p = start + i
        out = mix(out * _BASE + np.where(p < last, pad[np.minimum(p, len(pad) - 1)], np.uint64(i + 1)))
    return at, out


def occurrence_labels(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of each value with the number of its earlier occurrences in the same document."""
    if not len(x):
        return x
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((x, doc))
    sx, sd = x[order], doc[order]
    new = np.concatenate(([True], (sx[1:] != sx[:-1]) | (sd[1:] != sd[:-1])))
    start = np.flatnonzero(new)
    nth = np.arange(len(x)) - np.repeat(start, np.diff(np.concatenate((start, [len(x)]))))
    out = np.empty_like(x)
    out[order] = mix(sx + nth.astype(np.uint64) * _STEP)
    return out


def code_point_ends(data: np.ndarray) -> np.ndarray:
    """Number of characters that begin before each byte position (one longer than ``data``)."""
    return np.concatenate((np.zeros(1, np.int32), np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)))


def list_array(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), values)
