"""Byte-level BPE: texts into token ids by replaying the merges over the distinct words of many texts, and back."""

from __future__ import annotations

import base64
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, functions as F

from verdictlab.llm.text import bounded_batches

#: A worker keeps the ids of so many words, in so many bytes; beyond that it begins anew.
CACHE_WORDS, CACHE_BYTES = 200_000, 1 << 24

#: Characters of a long text that are split into words at once.
PIECE = 1 << 20

_NONE = np.int64(1 << 40)


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file of lines ``base64(token) rank``."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class _Rows(dict):
    """Words numbered in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Merges:
    """Tokens, and the rank of each pair of tokens that makes another. As large as the vocabulary, so it may be broadcast."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        lacks = [b for b in range(256) if bytes([b]) not in ranks]
        if lacks:
            raise ValueError(f"the vocabulary has no token for the bytes {lacks[:5]}")
        self.pattern = pattern
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.tokens[r] = t
        found = {}
        for t, r in ranks.items():
            for i in range(1, len(t)):
                a, b = ranks.get(t[:i]), ranks.get(t[i:])
                if a is not None and b is not None:
                    found[a * len(self.tokens) + b] = r
        self.pairs = np.array(sorted(found), np.int64)
        self.made = np.array([found[k] for k in self.pairs.tolist()], np.int64)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self._begin()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._begin()

    def _begin(self) -> None:
        self._split = regex.compile(self.pattern)
        self._whole = {t: r for r, t in enumerate(self.tokens) if t}
        self._forget()

    def _forget(self) -> None:
        self._rows, self._offs, self._ids = _Rows(), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that a and b make together; ``_NONE`` where they make none."""
        if not len(self.pairs):
            return np.full(len(a), _NONE)
        key = a * len(self.tokens) + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.made[at], _NONE)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``(first id of each word plus the end, ids)`` of words that aren't empty.

        All words lie in one array of tokens with links to their neighbours. An inverted index has the positions of
        each pair; pairs are taken by rising rank, a pair is merged wherever it (still) stands, the left one first where
        two overlap, and only the two pairs around each merged place are looked up and entered anew.
        """
        data = np.frombuffer(b"".join(words), np.uint8)
        offs = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
        n = len(data)
        token = np.append(self.of_byte[data], -1)
        right, left = np.arange(1, n + 2), np.arange(-1, n)
        right[offs[1:] - 1] = n  # n: no neighbour
        left[offs[:-1]] = n
        alive = np.ones(n + 1, bool)
        alive[n] = False
        rank = np.full(n + 1, _NONE)
        inner = np.flatnonzero(right[:n] < n)
        rank[inner] = self.rank(token[inner], token[inner + 1])
        index: dict[int, list[np.ndarray]] = {}
        _enter(index, inner, rank[inner])
        queue, odd = list(index), []
        heapify(queue)
        while queue:
            r = heappop(queue)
            at = np.concatenate(index.pop(r))
            at = np.unique(at[rank[at] == r])
            if not len(at):
                continue
            if len(at) > 1 and (chained := np.append(False, right[at[:-1]] == at[1:])).any():
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(chained, 0, place))) % 2 == 0]
            gone = right[at]
            after = right[gone]
            if (close := after[:-1] == at[1:]).any():  # between two merges side by side there was another pair for a moment
                x = at[1:][close]
                odd.append(x[self.rank(np.full(len(x), r), token[x]) < r])
            token[at], right[at] = r, after
            alive[gone], rank[gone], rank[at] = False, _NONE, _NONE
            left[after] = at
            left[n] = n
            before = left[at]
            touched = np.concatenate((before[before < n], at[after < n]))
            new = rank[touched] = self.rank(token[touched], token[right[touched]])
            some = new < _NONE
            for x in _enter(index, touched[some], new[some]):
                heappush(queue, x)
            if len(low := touched[new < r]):
                odd.append(low)
        first = np.append(0, np.cumsum(alive[:n]))
        ids = token[:n][alive[:n]].astype(np.int32)
        # a merge has made a pair of lower rank, which the word should have merged before it went on with this one
        redo = np.unique(np.searchsorted(offs, np.concatenate(odd), "right") - 1).tolist() if odd else []
        if not redo:
            return first[offs], ids
        each = np.split(ids, first[offs[1:-1]])
        for i in redo:
            each[i] = self.one_by_one(words[i])
        return np.append(0, np.cumsum([len(x) for x in each])), np.concatenate(each)

    def one_by_one(self, word: bytes) -> np.ndarray:
        """The ids of one word, merging its leftmost pair of lowest rank until there is none."""
        token = self.of_byte[np.frombuffer(word, np.uint8)]
        while len(token) > 1:
            rank = self.rank(token[:-1], token[1:])
            i = int(rank.argmin())
            if rank[i] == _NONE:
                break
            token = np.concatenate((token[:i], rank[i : i + 1], token[i + 2 :]))
        return token.astype(np.int32)

    def _words(self, text: str) -> np.ndarray:
        """The numbers of the words of ``text``, which is split piece by piece: what ends close to the end of a piece is
        left to the next one."""
        out, at, size = [], 0, PIECE
        while at < len(text):
            end = min(at + size, len(text))
            found, then = self._split.findall(text, at, end), end
            if end < len(text):
                ends = at + np.cumsum([len(w) for w in found])
                k = int(np.searchsorted(ends, end - 16, "right"))
                if not k:
                    size *= 2
                    continue
                found, then = found[:k], int(ends[k - 1])
            out.append(np.fromiter(map(self._rows.__getitem__, found), np.int64, len(found)))
            at, size = then, PIECE
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def _learn(self) -> None:
        """Give ids to the words that have none yet."""
        known = len(self._offs) - 1
        new = [w.encode() for w in islice(self._rows, known, None)]
        if not new:
            return
        whole = np.array([self._whole.get(w, -1) for w in new], np.int64)
        size = np.ones(len(new), np.int64)
        rest = np.flatnonzero(whole < 0)
        offs, ids = self.replay([new[i] for i in rest]) if len(rest) else (np.zeros(1, np.int64), np.zeros(0, np.int32))
        size[rest] = np.diff(offs)
        own = np.empty(size.sum(), np.int32)
        merged = np.repeat(whole < 0, size)
        own[merged], own[~merged] = ids, whole[whole >= 0]
        self._offs = np.concatenate((self._offs, self._offs[-1] + np.cumsum(size)))
        self._ids = np.concatenate((self._ids, own))

    def encode(self, texts: pa.Array) -> pa.ListArray:
        if len(self._rows) > CACHE_WORDS or 4 * len(self._ids) > CACHE_BYTES:
            self._forget()
        raw = pc.fill_null(texts.cast(pa.large_binary()), b"").to_pylist()
        rows = [self._words(t.decode("utf-8", "replace")) for t in raw]
        self._learn()
        ids, sizes = [], []
        for r in rows:
            size = self._offs[r + 1] - self._offs[r]
            total = int(size.sum())
            sizes.append(total)
            ids.append(self._ids[np.repeat(self._offs[r] - (np.cumsum(size) - size), size) + np.arange(total)])
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(np.concatenate(ids) if ids else [], pa.int32()))


def _enter(index: dict[int, list[np.ndarray]], at: np.ndarray, rank: np.ndarray) -> list[int]:
    """Enter positions under their rank; the ranks that weren't there."""
    order = np.argsort(rank, kind="stable")
    at, rank = at[order], rank[order]
    cut = np.flatnonzero(np.diff(rank)) + 1
    new = []
    for x, own in zip(rank[np.append(0, cut)].tolist() if len(rank) else [], np.split(at, cut), strict=False):
        if x < _NONE:
            if x not in index:
                index[x] = []
                new.append(x)
            index[x].append(own)
    return new


def encode(docs: DataFrame, merges: Merges, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the array column ``out`` of the token ids of the whole text (it replaces a column of that name).

    Each match of the pattern is a word. A word that is a token is its id; from the others the merges make ids, replayed
    in rank order over all distinct words that a batch of texts has and its worker hasn't met yet. Merges never cross
    words, so it doesn't matter which words are replayed together, and no text or word is shuffled; a worker keeps the
    ids of ``CACHE_WORDS`` words or so. Long texts are split piece by piece. Special tokens are ordinary text. Null text
    has no ids, as empty text; what isn't UTF-8 is read as U+FFFD. Rows are encoded one by one, so repeated rows agree,
    an empty table stays empty and other columns pass through.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(merges)

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        return shared.value.encode(texts)

    return docs.withColumn(out, ids.asNondeterministic()(F.col(text)))


def _lists(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(offsets, values)`` of a list array; a null list is empty, a null id is -1."""
    sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    values = pc.fill_null(ids.flatten(), -1).to_numpy(zero_copy_only=False)
    return np.append(0, np.cumsum(sizes)), values


def decode(docs: DataFrame, merges: Merges, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the binary column ``out``: the bytes of the tokens, one after the other. Null has none; an id that is
    null or not in the vocabulary stands for no bytes."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast([*merges.tokens, b""])

    @F.arrow_udf("binary")
    def decoded(lists: pa.Array) -> pa.Array:
        tokens = shared.value
        offs, values = _lists(lists)
        values = np.where((values >= 0) & (values < len(tokens)), values, len(tokens) - 1)
        texts = [b"".join(b"".join(map(tokens.__getitem__, values[p : min(p + PIECE, b)].tolist())) for p in range(a, b, PIECE)) for a, b in zip(offs[:-1], offs[1:], strict=True)]
        return pa.array(texts, pa.binary())

    return docs.withColumn(out, decoded.asNondeterministic()(F.col(ids)))


def packed(ids: Column) -> Column:
    """Ids as little-endian unsigned 32-bit integers, one after the other, as token files have them."""

    @F.arrow_udf("binary")
    def pack(lists: pa.Array) -> pa.Array:
        offs, values = _lists(lists)
        raw = np.ascontiguousarray(values.astype("<u4"))
        return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer((4 * offs).astype(np.int32)), pa.py_buffer(raw)])

    return pack(ids)
