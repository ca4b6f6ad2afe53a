"""URL filters: host and path rules, and logistic regression on hashed character n-grams for all other URLs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from verdictlab.llm.text import blocks, bounded_batches, byte_table, mix

BITS = 12
DIM = 1 << BITS
GRAMS = (3, 4, 5)
#: Bytes whose n-grams are made at once.
PIECE = 1 << 18
_TABLE = byte_table(b"", lower=True)


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    at = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(at, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def with_rules(urls: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule`` and ``rule_verdict`` (null where no rule fits). The longest fitting
    rule wins (ties: the first by name). Null URLs and those without ``://`` have an empty host and path, which no rule
    fits. ``rules`` is a short list (up to a few thousand), compiled into one expression."""
    d = urls.withColumn("host", host(F.col(url))).withColumn("path", path(F.col(url)))
    fits = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name), reverse=True):
        own = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        fits, verdict = F.when(own, r.name).otherwise(fits), F.when(own, r.verdict).otherwise(verdict)
    return d.withColumn("rule", fits).withColumn("rule_verdict", verdict)


def _grams(data: np.ndarray, offs: np.ndarray, salt: int, most: int) -> np.ndarray:
    """``document * DIM + feature`` of the n-grams of each text that begin before ``most``; n-grams don't cross texts."""
    c = _TABLE[data].astype(np.uint64) + np.uint64(1)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    found = []
    h = c.copy()
    for n in range(2, max(GRAMS) + 1):
        if len(h) < 2:
            break
        h = h[:-1] * np.uint64(257) + c[n - 1 :]
        if n in GRAMS:
            k = min(len(h), most)
            whole = doc[:k] == doc[n - 1 : n - 1 + k]
            feature = (mix(h[:k][whole] + np.uint64(salt * 1000 + n)) & np.uint64(DIM - 1)).astype(np.int64)
            found.append(doc[:k][whole] * DIM + feature)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _counts(hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(row * DIM + feature, count)`` of host and path together. Texts are read in blocks and a long one in pieces, each
    of which leaves its counts."""
    cells, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for salt, col in ((1, hosts), (2, paths)):
        for first, data, offs in blocks(col, PIECE):
            if len(offs) == 2:  # a single text, of any length
                pieces = [data[p : p + PIECE + max(GRAMS) - 1] for p in range(0, len(data), PIECE)]
                parts = (_grams(x, np.array([0, len(x)]), salt, PIECE) for x in pieces)
            else:
                parts = [_grams(data, offs, salt, len(data))]
            for found in parts:
                cell, count = np.unique(found, return_counts=True)
                cells.append(cell + first * DIM)
                counts.append(count)
    cell, back = np.unique(np.concatenate(cells), return_inverse=True)
    return cell, np.bincount(back, np.concatenate(counts), len(cell))


def fit(labelled: DataFrame, max_urls: int = 2000, rounds: int = 300, rate: float = 1.0, ridge: float = 1e-4) -> np.ndarray:
    """Weights (the last is the bias) of P(block), from ``labelled(host, path, verdict)``.

    A small table by intent: at most ``max_urls`` distinct URLs, half of each verdict where there are enough, chosen
    by a hash. With labels of one kind only, or none, the weights are zero but the bias, which gives that verdict
    (none: allow)."""
    rows = labelled.select("host", "path", "verdict").distinct().withColumn("h", F.xxhash64("host", "path"))
    got = []
    for v in ("allow", "block"):
        got += rows.filter(F.col("verdict") == v).orderBy("h", "host", "path").limit(max_urls // 2).collect()
    y = np.array([r["verdict"] == "block" for r in got], float)
    w = np.zeros(DIM + 1)
    if not len(y) or y.min() == y.max():
        w[-1] = 1.0 if len(y) and y[0] else -1.0
        return w
    # counts of n-grams as (URL, feature, part of the URL's unit vector): few of the features occur in a URL
    cell, count = _counts(pa.array([r["host"] for r in got]), pa.array([r["path"] for r in got]))
    row, feature = cell // DIM, cell % DIM
    part = count / np.sqrt(np.bincount(row, count.astype(float) ** 2, len(got)))[row]
    speed = np.zeros(DIM + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(np.bincount(row, w[feature] * part, len(got)) + w[-1])))
        g = (p - y) / len(y)
        step = np.concatenate((np.bincount(feature, part * g[row], DIM) + ridge * w[:-1], [g.sum()]))
        speed = 0.9 * speed - 4 * rate * step
        w += speed
    return w


def judge(urls: DataFrame, weights: np.ndarray, out: str = "p_block") -> DataFrame:
    """``urls`` (with ``host`` and ``path``) with the probability that the URL is to be blocked."""
    bounded_batches(urls.sparkSession)
    shared = urls.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def score(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        w, n = shared.value, len(hosts)
        cell, count = _counts(hosts, paths)
        row, feature = cell // DIM, cell % DIM
        length = np.sqrt(np.bincount(row, count**2, n))
        z = np.bincount(row, w[feature] * count, n) / np.maximum(length, 1e-9) + w[-1]
        return pa.array(1 / (1 + np.exp(-z)), pa.float64())

    return urls.withColumn(out, score.asNondeterministic()(F.col("host"), F.col("path")))


def filter_urls(urls: DataFrame, rules: list[Rule], labelled: DataFrame | None = None, url: str = "url", limit: float = 0.5) -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule``, ``p_block`` and ``verdict``: the rule's where one fits, else
    ``block`` where the model's probability is over ``limit``. The model is trained from ``labelled(host, path,
    verdict)``, or from the URLs that rules decide. Columns of these names are replaced, others pass through; rows
    are judged one by one, so repeated rows agree; an empty table stays empty. A URL of any length is judged whole, piece by
    piece."""
    d = with_rules(urls, rules, url)
    if labelled is None:
        labelled = d.filter(F.col("rule").isNotNull()).select("host", "path", F.col("rule_verdict").alias("verdict"))
    d = judge(d, fit(labelled))
    by_model = F.when(F.col("p_block") > limit, "block").otherwise("allow")
    return d.withColumn("verdict", F.coalesce("rule_verdict", by_model)).drop("rule_verdict")
