"""Near-duplicate documents by Order MinHash, verified by banded alignment."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from verdictlab.functions.shared import materialise
from verdictlab.llm.linking import classes
from verdictlab.llm.text import blocks, bounded_batches, list_array, mix, occurrence_labels, shingles, words

#: Words of a k-mer; least similarity; sketches of a document; k-mers of a sketch.
K, SIMILAR, SKETCHES, MINIMA = 5, 0.8, 24, 4
_ODD = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64)) | np.uint64(1)
_XOR = mix(np.arange(101, SKETCHES + 101, dtype=np.uint64))


#: k-mers of a text that are hashed at once.
PIECE = 1 << 14


def sketch(x: np.ndarray) -> np.ndarray:
    """Order MinHash of the occurrence-labelled k-mers ``x`` (in text order): for each of ``SKETCHES`` random orders,
    the ``MINIMA`` smallest k-mers, put back into text order and hashed as a sequence. A long text goes through in
    pieces, of which each leaves its smallest k-mers."""
    take = min(MINIMA, len(x))
    best = at = None
    for p in range(0, len(x), PIECE):
        v = (x[None, p : p + PIECE] ^ _XOR[:, None]) * _ODD[:, None]
        v ^= v >> np.uint64(29)
        places = np.broadcast_to(np.arange(p, p + v.shape[1]), v.shape)
        if best is not None:
            v, places = np.hstack((best, v)), np.hstack((at, places))
        if take < v.shape[1]:
            least = np.argpartition(v, take - 1, axis=1)[:, :take]
            v, places = np.take_along_axis(v, least, 1), np.take_along_axis(places, least, 1)
        best, at = v, places
    at = np.sort(at, axis=1)
    out = np.arange(SKETCHES, dtype=np.uint64) * np.uint64(MINIMA + 1) + np.uint64(take)
    for i in range(take):
        out = mix(out ^ x[at[:, i]])
    return out


def _labelled(texts: pa.Array):
    """For each block: ``(first k-mer of each document plus the end, occurrence-labelled k-mer hashes, hashes)``."""
    for _, data, offs in blocks(texts):
        first, _, _, h = words(data, offs)
        at, s = shingles(h, first, K)
        yield np.diff(first), at, occurrence_labels(s, at), s


def _sketches(texts: pa.Array) -> pa.Array:
    """Digest of the normalised words and sketches; none for a text without words."""
    sizes, digests, keys, counts = [], [], [], []
    for n, at, x, s in _labelled(texts):
        for i in range(len(n)):
            a, b = at[i], at[i + 1]
            sizes.append(int(n[i]))
            if a == b:
                digests.append(None)
                counts.append(0)
                continue
            turn = mix(np.arange(b - a, dtype=np.uint64)) | np.uint64(1)
            digests.append(int(mix((s[a:b] * turn).sum(keepdims=True) + np.uint64(n[i]))[0].astype(np.int64)))
            keys.append(sketch(x[a:b]))
            counts.append(SKETCHES)
    flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
    return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(digests, pa.int64()), list_array(pa.array(flat), np.array(counts, np.int64))], names=["n_words", "digest", "keys"])


def _kmers(texts: pa.Array) -> pa.Array:
    """The occurrence-labelled k-mers in text order, four bytes each."""
    out = []
    for n, at, x, _ in _labelled(texts):
        y = (x >> np.uint64(32)).astype(np.uint32)
        out += [y[at[i] : at[i + 1]].tobytes() for i in range(len(n))]
    return pa.array(out, pa.binary())


def _sets(kmers: pa.Array) -> pa.Array:
    """The set of the labelled k-mers of each document; aligned k-mers are among those that two sets share."""
    sets = [np.unique(np.frombuffer(x, np.uint32)).astype(np.int64) for x in kmers.to_pylist()]
    return list_array(pa.array(np.concatenate([np.zeros(0, np.int64), *sets])), np.array([len(x) for x in sets], np.int64))


def alignment(a: np.ndarray, b: np.ndarray, similar: float) -> float:
    """Similarity of two k-mer sequences: aligned k-mers over all k-mers of either. The alignment is the longest
    common subsequence inside the band that a similarity of ``similar`` allows; 0 where that can't be reached.
    Labelled k-mers are distinct, so it is a longest increasing run of partner positions. One minus it is the edit
    distance with insertions and deletions only, normalised so that it is a metric."""
    n, m = len(a), len(b)
    need = similar * (n + m) / (1 + similar)
    if min(n, m) < need - 1e-9:
        return 0.0
    _, i, j = np.intersect1d(a, b, return_indices=True)
    if len(i) < need - 1e-9:
        return 0.0
    band = n + m - 2 * need + 1
    keep = np.abs(i - j) <= band
    order = np.argsort(i[keep], kind="stable")
    j = j[keep][order]
    if len(j) > 1 and (np.diff(j) < 0).any():
        tails: list[int] = []
        for p in j.tolist():
            k = bisect_left(tails, p)
            tails[k : k + 1] = [p]
        most = len(tails)
    else:
        most = len(j)
    return most / (n + m - most) if most >= need - 1e-9 else 0.0


def _similarity(similar: float):
    @F.arrow_udf("double")
    def similarity(a: pa.Array, b: pa.Array) -> pa.Array:
        get = lambda x: np.frombuffer(x.as_py(), np.uint32)
        return pa.array([alignment(get(x), get(y), similar) for x, y in zip(a, b, strict=True)], pa.float64())

    return similarity.asNondeterministic()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", similar: float = SIMILAR) -> DataFrame:
    """``(key, text_hash, class_id, n_words, copies, is_kept)``, one row per document: documents of one class are near
    copies of each other, by links of a similarity of ``similar`` or more; ``class_id`` is the smallest key of the class,
    ``is_kept`` tells the document of that key (and of the smallest ``text_hash``); ``copies`` counts the documents of
    equal words.

    Words are normalised (A-Z lower, no punctuation); k-mers are five words, labelled by occurrence; a shorter text
    is one k-mer. Texts of equal words are one class from the start and are compared once. A text without words
    (null and empty too) is a class of its own. Keys are integers; rows with a null key are left out. Rows of one key
    with different texts are documents of their own, told apart by ``text_hash``; repeated rows of one key and text
    count once. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    sketches = F.arrow_udf(_sketches, "struct<n_words: bigint, digest: bigint, keys: array<bigint>>").asNondeterministic()
    kmers = F.arrow_udf(_kmers, "binary").asNondeterministic()
    source = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("t"))
    base = materialise(source.select("id", "h", sketches("t").alias("s")).select("id", "h", "s.*"))
    slim = base.select("id", "h", "n_words", "digest").distinct()
    own = slim.filter(F.col("digest").isNotNull())
    reps = materialise(own.groupBy("digest").agg(F.min(F.struct("id", "h")).alias("rep"), F.count(F.lit(1)).alias("copies")))
    signatures = materialise(base.filter(F.col("digest").isNotNull()).select(F.col("digest").alias("id"), "keys").dropDuplicates(["id"]))

    def prepare(ids: DataFrame):
        one = materialise(reps.join(ids, F.col("digest") == F.col("id")).select("rep.id", "rep.h", "digest"))
        # this table grows with the documents, so it is a sort-merge join at every size
        v = source.join(one.hint("merge"), ["id", "h"]).select(F.col("digest").alias("id"), kmers("t").alias("x"))
        v = materialise(v.dropDuplicates(["id"]))

        def score(pairs: DataFrame) -> DataFrame:
            p = pairs.join(v.select(F.col("id").alias("b"), F.col("x").alias("y")), "b").join(v.withColumnRenamed("id", "a"), "a")
            least = 2 * similar - 1
            return p.withColumn("s", _similarity(least)(F.col("x"), F.col("y"))).filter(F.col("s") >= least).select("a", "b", "s")

        toks = F.arrow_udf(_sets, "array<bigint>").asNondeterministic()
        return score, lambda ids: v.join(ids, "id").select("id", toks("x").alias("toks"))

    found = classes(signatures, prepare, similar)
    named = reps.join(found.withColumnRenamed("id", "digest"), "digest", "left").withColumn("class", F.coalesce("class", "digest"))
    keep = named.groupBy("class").agg(F.min("rep").alias("keep"))
    named = named.join(keep, "class").select("digest", "copies", "keep")
    this = F.struct("id", "h")
    kept = F.coalesce("keep", this)
    return slim.join(named, "digest", "left").select(
        F.col("id").alias(key), F.col("h").alias("text_hash"), kept["id"].alias("class_id"), "n_words",
        F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), (this == kept).alias("is_kept"),
    )


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", similar: float = SIMILAR) -> DataFrame:
    """``docs`` with one document of each class, the one of the smallest key; rows with a null key stay as they are.
    Repeated rows of one key and text are one document: they stay or go together."""
    found = near_duplicates(docs, text, key, similar).filter(~F.col("is_kept")).select(F.col(key).alias("__gone"), F.col("text_hash").alias("__h"))
    # this table grows with the documents, so it is a sort-merge join at every size
    return docs.join(found.hint("merge"), (F.col(key).cast("long") == F.col("__gone")) & (F.xxhash64(F.col(text)) == F.col("__h")), "left_anti")
