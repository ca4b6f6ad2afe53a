"""Secret scan in DataFrame functions only: fixed patterns, and character Markov models compared by log-likelihood.

Two first-order Markov models of characters, one of random strings and one of ordinary identifiers, are counted from
labelled samples by Spark; the table of log ratios of their transitions (about 70 x 70 numbers) scores each
candidate token. No Python runs on the executors.
"""

from __future__ import annotations

import json
from functools import reduce
from math import log
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from verdictlab.functions.shared import materialise

#: Patterns: kind, expression, group whose length counts, least length.
BASE = (
    ("assign", r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{24,}+", 0, 24),
)
#: Words of which a text with an assignment has one, in lower case.
ASSIGNED = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "markov")
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="
SPAN = "array<struct<start: int, kind: int, end: int>>"
#: Matches laid end to end in one go; the offsets of such stretches are summed up apart, so the cost stays linear.
STRETCH = 256


class Model(NamedTuple):
    """Log ratios of the transitions, row by row of the alphabet, and the mean from which a token counts as random."""

    ratios: list[float]
    least: float


def _pieces(text: Column, pattern: str, group: int = 0) -> Column:
    """The text as ``(gap, hit, own)``: what stands before each match, the match, and its ``group``; the last has a gap only."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    own = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    return F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"), own.alias("own"))


def _width(x: Column) -> Column:
    return F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))


def _positions(pieces: Column, kind: int, least: int = 0) -> Column:
    """``(start, kind, end, hit)`` (code points, end exclusive) of the matches whose ``own`` has ``least`` characters."""
    kept = "array<struct<start: int, kind: int, end: int, hit: string>>"

    def step(acc: Column, x: Column) -> Column:
        begin, end = acc["at"] + F.length(x["gap"]), acc["at"] + _width(x)
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["hit"].alias("hit"))
        long = x["hit"].isNotNull() & (F.length(x["own"]) >= least)
        return F.struct(end.alias("at"), F.when(long, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    stretches = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / STRETCH).cast("int")), lambda i: F.slice(pieces, i * STRETCH + 1, STRETCH))
    widths = F.transform(stretches, lambda s: F.aggregate(s, F.lit(0), lambda acc, x: acc + _width(x)))
    starts = F.aggregate(widths, F.array(F.lit(0)), lambda acc, w: F.array_append(acc, F.element_at(acc, -1) + w))
    both = F.arrays_zip(stretches.alias("s"), F.slice(starts, 1, F.size(starts) - 1).alias("at"))
    start = lambda x: F.struct(x["at"].alias("at"), F.array().cast(kept).alias("spans"))
    return F.flatten(F.transform(both, lambda x: F.aggregate(x["s"], start(x), step, lambda acc: acc["spans"])))


def _may(text: Column, kind: str) -> Column:
    """Whether a match is possible, by a cheaper look."""
    if kind == "assign":
        return reduce(or_, [F.contains(F.lower(text), F.lit(w)) for w in ASSIGNED])
    return F.contains(text, F.lit("AKIA")) if kind == "access" else text.rlike(BASE[2][1])


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, sorted by start, then by kind as listed."""
    none = F.array().cast(SPAN)
    found = []
    for no, (kind, pattern, group, least) in enumerate(BASE):
        spans = F.transform(_positions(_pieces(text, pattern, group), no, least), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
        found.append(F.when(_may(text, kind), spans).otherwise(none))
    return F.array_sort(F.concat(*found))


def _without_base(text: Column) -> Column:
    """``text`` with blanks in the place of what the fixed patterns find, so that positions stay."""
    for kind, pattern, group, least in BASE:
        blank = lambda x: F.when(F.length(x["own"]) >= least, F.repeat(F.lit(" "), F.length(x["hit"]))).otherwise(F.coalesce(x["hit"], F.lit("")))  # noqa: B023, E731
        text = F.when(_may(text, kind), F.array_join(F.transform(_pieces(text, pattern, group), lambda x: F.concat(x["gap"], blank(x))), "")).otherwise(text)  # noqa: B023
    return text


def _indexes(token: Column) -> Column:
    """Places of the characters in the alphabet, from 1."""
    return F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def samples(docs: DataFrame, text: str = "text", key: str = "doc_id", max_docs: int = 1000) -> DataFrame:
    """Labelled samples ``(token, random)`` from at most about ``max_docs`` documents, chosen by a hash of ``key``.

    Random: what the fixed patterns found, and hashes of the keys written as hex, base64 and capital alphanumerics.
    Ordinary: the words of the texts with no digit, alone and joined as identifiers are (snake_case, kebab-case,
    CamelCase)."""
    n = docs.count()
    draw = F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(23)), 11) / F.lit(float(1 << 53))
    few = docs.filter(F.col(text).isNotNull() & (draw < min(1.0, max_docs / max(n, 1)))).select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"))
    # the words of few documents are many tokens: all cores shall make them
    few = materialise(few.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), "k"))
    few = few.withColumn("words", F.regexp_extract_all("t", F.lit(r"(?<![0-9A-Za-z])[A-Za-z]{2,}(?![0-9A-Za-z=])"), F.lit(0)))
    hashed = F.unhex(F.sha2("k", 256))
    made = F.array(
        F.sha2(F.concat(F.lit("h"), "k"), 256), F.base64(hashed), F.translate(F.base64(hashed), "+/=", "-_"),
        F.upper(F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(F.lit("u"), "k"), 256))), "[^A-Za-z0-9]", "")),
    )
    known = F.transform(base_spans(F.col("t")), lambda x: F.regexp_extract(F.substring(F.col("t"), x["start"] + 1, x["end"] - x["start"]), r"([A-Za-z0-9+/_-]+=*)$", 1))
    w = F.col("words")
    pairs = F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.struct(a.alias("a"), F.coalesce(b, a).alias("b")))
    ordinary = F.flatten(F.transform(pairs, lambda x: F.array(
        x["a"], F.concat_ws("_", x["a"], x["b"]), F.concat_ws("-", x["a"], x["b"]), F.concat(F.initcap(x["a"]), F.initcap(x["b"]))
    )))
    both = few.select(F.explode(F.concat(made, known)).alias("token"), F.lit(True).alias("random")).unionByName(
        few.select(F.explode(ordinary).alias("token"), F.lit(False).alias("random"))
    )
    return both.filter(F.length("token") >= 2)


def train(labelled: DataFrame, smooth: float = 0.5, long: int = 16) -> Model:
    """Log ratios of transition probabilities, random over ordinary (add-``smooth``), and the threshold: half-way between
    what one in a thousand ordinary and 99 of a hundred random tokens of ``long`` characters or more score. Only the
    counts of character pairs, a table of bounded size, and the two scores reach the driver."""
    k = len(ALPHABET)
    # equal tokens are counted once, and then stand for as many
    labelled = materialise(labelled.groupBy("random", "token").agg(F.count(F.lit(1)).alias("times")))
    at = _indexes(F.col("token"))
    pairs = F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    got = labelled.select("random", "times", F.explode(pairs).alias("p")).filter("p.a > 0 and p.b > 0").groupBy("random", "p.a", "p.b").agg(F.sum("times").alias("n")).collect()
    n = {(r["random"], r["a"], r["b"]): r["n"] for r in got}
    ratios = []
    for a in range(1, k + 1):
        total = {z: sum(n.get((z, a, b), 0) for b in range(1, k + 1)) + smooth * k for z in (True, False)}
        ratios += [log((n.get((True, a, b), 0) + smooth) / total[True]) - log((n.get((False, a, b), 0) + smooth) / total[False]) for b in range(1, k + 1)]
    scored = labelled.filter(F.length("token") >= long).select("random", "times", F.round(score(F.col("token"), ratios), 4).alias("s"))
    at = {r["random"]: r["at"] for r in scored.groupBy("random").agg(F.percentile("s", F.array(F.lit(0.01), F.lit(0.999)), F.col("times")).alias("at")).collect()}
    low, high = at.get(False, [0.0, 0.0])[1], at.get(True, [0.0, 0.0])[0]
    return Model(ratios, max(0.0, (low + high) / 2))


def score(token: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio of the token's transitions (positive: rather random)."""
    k = len(ALPHABET)
    table = F.from_json(F.lit(json.dumps([round(x, 6) for x in ratios])), "array<double>")
    at = _indexes(token)
    steps = F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1), lambda a, b: F.element_at(table, (a - 1) * k + b))
    return F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x) / F.greatest(F.size(at) - 1, F.lit(1))


def scan(docs: DataFrame, model: Model, text: str = "text", out: str = "secrets") -> DataFrame:
    """``docs`` with the struct column ``out`` of ``base`` and ``spans`` (arrays of start, kind, end; by start, then
    kind; ``kind`` is a place in ``KINDS``), which replaces a column of that name.

    ``spans`` are the base spans and those candidate tokens (16 or more characters, a letter among them) in what the
    base spans leave, whose mean log-likelihood ratio is over the model's threshold. Null text is empty and has none;
    rows are scanned one by one, so repeated rows agree, an empty table stays empty, and other columns pass through. The
    cost is linear in the text and in its matches.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast(SPAN)
    base, rest = F.col(f"{out}__base"), F.col(f"{out}__rest")
    docs = docs.withColumn(f"{out}__base", base_spans(t))
    docs = docs.withColumn(f"{out}__rest", F.when(F.size(base) > 0, _without_base(t)).otherwise(t))
    more = F.filter(_positions(_pieces(rest, CANDIDATE), KINDS.index("markov")), lambda x: x["hit"].rlike("[A-Za-z]") & (score(x["hit"], model.ratios) > model.least))
    more = F.transform(more, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    more = F.when(rest.rlike(CANDIDATE), more).otherwise(none)
    return docs.withColumn(out, F.struct(base.alias("base"), F.array_sort(F.concat(base, more)).alias("spans"))).drop(f"{out}__base", f"{out}__rest")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"], x["end"])), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == KINDS.index(kind))).cast("long")
