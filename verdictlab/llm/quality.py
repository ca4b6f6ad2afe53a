"""Quality rules, line first: judge each line, drop the failing ones, then reject documents that lost too much."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from verdictlab.llm.text import blocks, bounded_batches, byte_table, list_array, mix, words

SPACE = b" \t\n\x0b\x0c\r"
TERMINAL = (b".", b"!", b"?", b":", b";", b'"', b"'", b")", b"\xe2\x80\xa6", b"\xe2\x80\x9d")
#: Stock phrases of web pages, lower case, in the languages at hand.
BOILERPLATE = (
    b"all rights reserved", b"cookie policy", b"privacy policy", b"terms of use", b"terms of service",
    b"click here", b"subscribe to our", b"sign up for", b"share this", b"enable javascript",
    b"alle rechte vorbehalten", b"nutzungsbedingungen", b"hier klicken", b"newsletter abonnieren", b"javascript aktivieren",
    b"tous droits r\xc3\xa9serv\xc3\xa9s", b"politique de confidentialit\xc3\xa9", b"conditions d'utilisation", b"cliquez ici", b"activer javascript",
    b"todos los derechos reservados", b"pol\xc3\xadtica de privacidad", b"t\xc3\xa9rminos de uso", b"haga clic aqu\xc3\xad", b"habilitar javascript",
)

_WORDS = byte_table(SPACE, lower=False)


def _class(members: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(members)] = True
    return t


_UPPER = _class(bytes(range(65, 91)))
_LETTERS = _UPPER | _class(bytes(range(97, 123)))
_PUNCTUATION = _class(bytes(i for i in range(33, 127) if not chr(i).isalnum()))
_SYMBOLS = _class(b"#*$%&|<>")
_SOLID = ~_class(SPACE)
_VISIBLE = _SOLID & ~_class(bytes(range(0x80, 0xC0)))

RESULT = (
    "struct<n_words: bigint, word_chars: bigint, n_symbols: bigint, n_dup_lines: bigint, n_repeat_words: bigint,"
    " base_failed: boolean, kept: boolean, lost_share: double, removed_lines: array<int>, text: string>"
)


def repeated_words(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """By document: words inside a window of three consecutive words that the document holds twice or more."""
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    if len(h) < 3:
        return np.zeros(n, np.int64)
    at = np.flatnonzero(doc[:-2] == doc[2:])
    w = mix(mix(mix(h[at]) + h[at + 1]) + h[at + 2]) + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    w = mix(w)
    order = np.argsort(w)
    same = w[order][1:] == w[order][:-1]
    twice = np.zeros(len(w), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(len(h), bool)
    for i in range(3):
        hit[at[twice] + i] = True
    return np.bincount(doc[hit], minlength=n)


def _judge(data: np.ndarray, offs: np.ndarray, max_lost: float, with_text: bool) -> tuple:
    """The fields of ``RESULT`` for a block of documents."""
    n_docs = len(offs) - 1
    count = lambda table: np.concatenate((np.zeros(1, np.int32), np.cumsum(table[data], dtype=np.int32)))
    first, start, end, h = words(data, offs, _WORDS)
    n_words, repeat = np.diff(first), repeated_words(h, first)
    visible, symbols = count(_VISIBLE), count(_SYMBOLS)
    word_chars, n_symbols = np.diff(visible[offs]), np.diff(symbols[offs])
    del symbols

    begin = np.union1d(np.flatnonzero(data == 10) + 1, offs[:-1])
    begin = begin[begin < len(data)]
    stop = np.concatenate((begin[1:], [len(data)])).astype(np.int64)
    doc = np.searchsorted(offs, begin, "right") - 1
    new = np.flatnonzero(np.diff(doc, prepend=-1))
    no = np.arange(len(begin)) - np.repeat(new, np.diff(np.append(new, len(begin))))
    line = np.searchsorted(begin, start, "right") - 1
    n = np.bincount(line, minlength=len(begin))

    per_line = lambda table: (c := count(table))[stop] - c[begin]
    mark = count(_PUNCTUATION)
    marks, solid = mark[stop] - mark[begin], per_line(_SOLID)
    menu = (end - start <= 3) & (mark[end] - mark[start] == end - start)
    bars = np.bincount(line[menu], minlength=len(begin))
    del mark
    bad = marks > np.where(n >= 5, 0.15, 0.4) * solid  # punctuation
    bad |= (n >= 5) & (per_line(_UPPER) > 0.6 * per_line(_LETTERS))
    bad |= (bars >= 3) & (5 * bars >= n)  # navigation
    big = np.flatnonzero(n[line] >= 30)  # a few words over and over
    if len(big):
        one = np.unique(mix(h[big] + line[big].astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)), return_index=True)[1]
        distinct = np.bincount(line[big[one]], minlength=len(begin))
        bad |= (n >= 30) & (distinct**2 < 4 * n)

    dup = np.zeros(len(begin), bool)
    seen: set[bytes] = set()
    raw, last = data.tobytes(), -1
    whole = raw.lower()
    phrases = [p for p in BOILERPLATE if p in whole]
    for i in np.flatnonzero(n > 0).tolist():
        if doc[i] != last:
            seen, last = set(), doc[i]
        text = raw[begin[i] : stop[i]].removesuffix(b"\n")
        if text in seen:
            dup[i] = True
            continue
        seen.add(text)
        if not bad[i] and n[i] <= 20:
            low = text.lower()
            bad[i] = n[i] < 3 and not text.rstrip(SPACE).endswith(TERMINAL) or any(p in low for p in phrases)
    bad = (bad | dup) & (n > 0)

    lost = np.bincount(doc[bad], (visible[stop] - visible[begin])[bad], n_docs)
    failed = (n_words < 50) | (100 * repeat > 50 * n_words)
    share = np.where(word_chars > 0, lost / np.maximum(word_chars, 1), 0.0)
    kept = ~failed & (share <= max_lost)
    gone = np.bincount(doc[bad], minlength=n_docs)
    clean: list[bytes | None] = [None] * n_docs
    if with_text:  # only what changed goes back to the JVM
        at = np.concatenate(([0], np.cumsum(gone)))
        own = no[bad]
        for d in np.flatnonzero(kept & (gone > 0)).tolist():
            skip = set(own[at[d] : at[d + 1]].tolist())
            clean[d] = b"\n".join(x for i, x in enumerate(raw[offs[d] : offs[d + 1]].split(b"\n")) if i not in skip)
    return n_words, word_chars, n_symbols, np.bincount(doc[dup], minlength=n_docs), repeat, failed, kept, share, (no[bad], gone), clean


def line_rules(docs: DataFrame, text: str = "text", out: str = "line_rules", max_lost: float = 0.5, with_text: bool = True) -> DataFrame:
    """``docs`` with the struct column ``out`` (``RESULT``), which replaces a column of that name.

    Words are runs of anything but the six ASCII white spaces. A line fails as *punctuation* (too many marks, or
    shouted), *navigation* (menu bars, or a stub without an end mark) or *boilerplate* (equal to an earlier line
    of the text, a few words over and over, or a stock phrase). Failing lines are taken out of ``text``; the
    document is rejected when it fails the base limits (under 50 words, or over half its words in repeated
    three-word windows) or when the failing lines held more than ``max_lost`` of its characters. ``text`` is
    the cleaned text of a kept document; it is null for others, and unless ``with_text``. Null text counts as empty: no words, so it is rejected. Each row is judged alone, so
    repeated rows and ties get equal results, and an empty table stays empty; other columns pass through.
    """
    bounded_batches(docs.sparkSession)
    kinds = (pa.int64(),) * 5 + (pa.bool_(), pa.bool_(), pa.float64(), pa.list_(pa.int32()), pa.string())
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_share", "removed_lines", "text"]
    kind = pa.struct(list(zip(names, kinds, strict=True)))

    @F.arrow_udf(RESULT)
    def rules(texts: pa.Array) -> pa.Array:
        parts = []
        for _, data, offs in blocks(texts):
            *plain, (no, gone), clean = _judge(data, offs, max_lost, with_text)
            cols = [pa.array(c, k) for c, k in zip(plain, kinds, strict=False)]
            cols += [list_array(pa.array(no, pa.int32()), gone), pa.array(clean, pa.binary()).cast(pa.string())]
            parts.append(pa.StructArray.from_arrays(cols, fields=list(kind)))
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    judged = docs.withColumn(out, rules.asNondeterministic()(F.col(text)))
    if not with_text:
        return judged
    own = F.col(out)
    return judged.withColumn(out, own.withField("text", F.when(own["kept"], F.coalesce(own["text"], F.col(text)))))
