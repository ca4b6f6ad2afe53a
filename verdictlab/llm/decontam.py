"""Benchmark decontamination by a generalised suffix automaton of the normalised test items."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from verdictlab.functions.shared import materialise
from verdictlab.llm.text import WORD_TABLE, bounded_batches

_TRANSLATE = bytes(b or 32 for b in WORD_TABLE.tobytes())


def tokens(text: bytes) -> list[bytes]:
    """Words of ASCII letters, digits and non-ASCII characters, A-Z in lower case."""
    return text.translate(_TRANSLATE).split()


class Automaton:
    """Suffix automaton of several token sequences. ``walk`` streams a document through it."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        own: list[set[int]] = [set()]
        ends: list[tuple[int, int, int]] = []
        self.names = [name for name, _ in items]
        self.min_run = window
        for no, (_, words) in enumerate(items):
            last = 0
            for w in words:
                last = self._extend(last, self.vocab.setdefault(w, len(self.vocab)), own)
                own[last].add(no)
            if 0 < len(words) < window:
                ends.append((last, len(words), no))
                self.min_run = min(self.min_run, len(words))
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            if self.link[v] > 0:
                own[self.link[v]] |= own[v]
        # items shorter than a window: whole item, by the state that its words lead to
        short: dict[int, dict[int, set[int]]] = {}
        for v, n, no in ends:
            short.setdefault(v, {}).setdefault(n, set()).add(no)
        #: By state: items that hold the window ending here, if the match is long enough; and short items.
        self.items: list[tuple[int, ...]] = [()] * len(self.len)
        self.short: list[tuple[tuple[int, tuple[int, ...]], ...]] = [()] * len(self.len)
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__):
            up = self.link[v]
            if self.len[v] >= window:
                self.items[v] = self.items[up] if self.len[up] >= window else tuple(sorted(own[v]))
            mine = tuple((n, tuple(sorted(s))) for n, s in short.get(v, {}).items())
            self.short[v] = mine + self.short[up] if up > 0 else mine

    def _extend(self, last: int, c: int, own: list[set[int]]) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._split(last, c, q, own)
        new = len(self.len)
        self.next.append({})
        self.len.append(self.len[last] + 1)
        self.link.append(0)
        own.append(set())
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, c, q, own)
        return new

    def _split(self, p: int, c: int, q: int, own: list[set[int]]) -> int:
        copy = len(self.len)
        self.next.append(dict(self.next[q]))
        self.len.append(self.len[p] + 1)
        self.link.append(self.link[q])
        own.append(set(own[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def walk(self, words: list[bytes]) -> tuple[list[list[int]], set[int]]:
        """Hit spans (first word, end, longest match inside) in order, and the numbers of the items."""
        ids = np.fromiter((self.vocab.get(w, -1) for w in words), np.int32, len(words))
        known = np.concatenate(([False], ids >= 0, [False]))
        turn = np.flatnonzero(known[1:] != known[:-1])
        spans: list[list[int]] = []
        found: set[int] = set()
        for a, b in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True):
            if b - a < self.min_run:
                continue
            v = n = 0
            for i, c in enumerate(ids[a:b].tolist(), a):
                while v and c not in self.next[v]:
                    v = self.link[v]
                    n = self.len[v]
                if c in self.next[v]:
                    v = self.next[v][c]
                    n += 1
                hit = n if n >= self.window else 0
                if hit:
                    found.update(self.items[v])
                for size, items in self.short[v]:
                    if size <= n:
                        found.update(items)
                        hit = max(hit, size)
                if hit:
                    start = i + 1 - hit
                    while spans and spans[-1][1] > start:
                        start = min(start, spans[-1][0])
                        hit = max(hit, spans[-1][2])
                        spans.pop()
                    spans.append([start, i + 1, hit])
        return spans, found


SPAN = "array<struct<start: int, end: int, longest: int>>"
RESULT = f"struct<n_words: bigint, spans: {SPAN}, items: array<string>>"


WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _n_blocks(items: DataFrame, text: str, max_words: int) -> int:
    """Into how many blocks the items are dealt, so that an automaton has a bounded size."""
    n = F.sum(F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)))
    return max(1, -(-(items.agg(n.alias("n")).first()["n"] or 0) // max_words))


def match(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", out: str = "contamination", window: int = 13, max_words: int = 200_000) -> DataFrame:
    """``docs`` with the struct column ``out``: ``n_words``, ``spans`` (word positions that lie in an occurrence of
    ``window`` consecutive words of an item, or of a whole shorter item, with the longest match inside) and ``items``
    (the items met, as strings, sorted).

    The test items are put into suffix automata of about ``max_words`` words each (a kilobyte a word). More items than
    that are dealt into blocks by a hash of their key, which are streamed over the documents one after the other: the
    result of a block is written before the next automaton is made and the last one is let go, so neither the
    driver, nor a broadcast, nor a worker holds more than one. Items without words, or without a key, are left out;
    equal items are all named. Null text has no words. Documents are judged row by row; an empty table stays empty; a
    column named ``out`` is replaced and all others pass through.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    blocks = _n_blocks(items, item_text, max_words)
    rows = items.select(F.col(item_key).cast("string").alias("k"), F.col(item_text).alias("t")).filter("k is not null and t is not null")
    for no in range(blocks):
        own = rows.filter(F.pmod(F.xxhash64("k"), F.lit(blocks)) == no).collect()
        listed = sorted((r["k"], tokens(r["t"].encode())) for r in own)
        shared = spark.sparkContext.broadcast(Automaton([(k, w) for k, w in listed if w], window))
        found = _matcher(shared)(F.col(text))
        if no == 0:
            docs = docs.withColumn(out, found)
        else:
            before, now = F.col(out), F.col(f"{out}__next")
            both = F.struct(now["n_words"].alias("n_words"), _join_spans(before["spans"], now["spans"]).alias("spans"), F.array_sort(F.array_union(before["items"], now["items"])).alias("items"))
            docs = docs.withColumn(f"{out}__next", found).withColumn(out, both).drop(f"{out}__next")
        if no + 1 < blocks:
            docs = materialise(docs)
            shared.destroy()
    return docs


def _matcher(shared):
    @F.arrow_udf(RESULT)
    def found(texts: pa.Array) -> pa.Array:
        a = shared.value
        n, spans, items = [], [], []
        for t in pc.fill_null(texts, "").cast(pa.large_string()).cast(pa.large_binary()):
            words = tokens(t.as_py())
            s, f = a.walk(words)
            n.append(len(words))
            spans.append([{"start": x, "end": y, "longest": z} for x, y, z in s])
            items.append(sorted({a.names[i] for i in f}))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("longest", pa.int32())]))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))], names=["n_words", "spans", "items"])

    return found.asNondeterministic()


def _join_spans(a, b):
    """Union of two sorted span lists; overlapping spans become one."""
    start = F.array().cast(SPAN)

    def add(acc, x):
        last = F.element_at(acc, -1)
        merged = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), F.greatest(last["longest"], x["longest"]).alias("longest"))
        return F.when((F.size(acc) > 0) & (x["start"] < last["end"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(merged))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(F.concat(a, b)), start, add)


def n_hit(out: str = "contamination"):
    return F.aggregate(F.col(out)["spans"], F.lit(0).cast("long"), lambda acc, x: acc + (x["end"] - x["start"]))


def contaminated(out: str = "contamination"):
    """The coverage limit: a twentieth of the document's words, and at least one."""
    return (n_hit(out) > 0) & (20 * n_hit(out) >= F.col(out)["n_words"])


def remove_spans(docs: DataFrame, text: str = "text", out: str = "contamination") -> DataFrame:
    """``text`` without the words of ``spans`` (and what stands between the words of one span)."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, found: pa.Array) -> pa.Array:
        done = []
        for t, spans in zip(texts, found, strict=True):
            spans = spans.as_py()
            if not t.is_valid or not spans:
                done.append(None)  # unchanged: the JVM has it
                continue
            raw = t.as_py().encode()
            c = np.frombuffer(raw.translate(_TRANSLATE), np.uint8) != 32
            start = np.flatnonzero(c & np.concatenate(([True], ~c[:-1])))
            end = np.flatnonzero(c & np.concatenate((~c[1:], [True]))) + 1
            parts, at = [], 0
            for s in spans:
                parts.append(raw[at : start[s["start"]]])
                at = int(end[s["end"] - 1])
            done.append(b"".join([*parts, raw[at:]]).decode())
        return pa.array(done, pa.string())

    return docs.withColumn(text, F.coalesce(cut.asNondeterministic()(F.col(text), F.col(out)["spans"]), F.col(text)))


def items_digest(out: str = "contamination"):
    """SHA-256 (hex) of the sorted, comma-joined item keys."""
    return F.sha2(F.array_join(F.col(out)["items"], ","), 256)


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", window: int = 13) -> DataFrame:
    """Documents over the coverage limit go as a whole; from the others, every span of a window or more goes.
    All columns stay as they are but ``text``. Documents without a hit are left as they were."""
    name = "__contamination"
    found = match(docs, items, text=text, out=name, window=window)
    return remove_spans(found.filter(~contaminated(name)), text=text, out=name).drop(name)
