"""Language identification in two steps: the language family, then one-versus-one linear SVMs inside it."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from verdictlab.llm.text import blocks, bounded_batches, byte_table

#: Family of a language code. A code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa si ur",
    "semitic": "am ar he mt",
}

#: Features are hashed three-byte windows of the folded text.
BITS = 13
DIM = 1 << BITS
_FOLD = byte_table(bytes(i for i in range(128) if not (65 <= i < 91 or 97 <= i < 123)))
_K = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes.split()), lang)


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(first feature of each document plus the end, feature number)``; each document is padded by itself."""
    c = _FOLD[data].astype(np.uint32)
    h = c * _K[0]
    h[1:] += c[:-1] * _K[1]
    h[2:] += c[:-2] * _K[2]
    f = (h >> np.uint32(32 - BITS)).astype(np.int32)
    # windows that would reach into the document before, and windows over non-letters alone, don't count
    ok = np.ones(len(data), bool)
    at = offs[:-1]
    ok[at[at < len(data)]] = False
    ok[at[at + 1 < len(data)] + 1] = False
    ok[2:] &= (c[2:] | c[1:-1] | c[:-2]) != 0
    keep = np.flatnonzero(ok)
    return np.searchsorted(keep, offs), f[keep]


@dataclass
class Model:
    """Weights by pair of classes, for families and for the languages of each family."""

    langs: list[str]
    families: list[str]
    between: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)
    within: dict[str, dict[tuple[str, str], np.ndarray]] = field(default_factory=dict)


def _svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Linear SVM (squared hinge loss) by dual coordinate descent; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    norm = (x * x).sum(1) + 0.5 / c
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1], np.float32)
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            step = max(alpha[i] - (y[i] * float(w @ x[i]) - 1 + 0.5 / c * alpha[i]) / norm[i], 0.0) - alpha[i]
            if step:
                alpha[i] += step
                w += np.float32(step * y[i]) * x[i]
    return w


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", max_docs: int = 1200) -> Model:
    """Fit on a bounded sample: at most ``max_docs`` labelled rows, shared evenly by the languages (of more than that,
    by the most frequent ones), each with its whole text. Rows are chosen by a hash of ``key``, so reruns agree. Rows without text, language or key are left
    out. No rows give a model that answers ``und``."""
    rows = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(key).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key), F.lit(11)).alias("h")
    )
    count = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not count:
        return Model([], [])
    # more languages than rows: those with the most labels
    count = dict(sorted(count.items(), key=lambda x: (-x[1], x[0]))[:max_docs])
    rows = rows.filter(F.col("lang").isin(*count))
    each = max_docs // len(count)
    # a hash threshold first, so that few texts are moved; then the exact bound
    shares = F.create_map(*[F.lit(v) for k, n in count.items() for v in (k, min(1.0, 2 * (each + 20) / n))])
    draw = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    few = rows.filter(draw < shares[F.col("lang")]).withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text")))

    @F.arrow_udf("struct<at: array<int>, n: array<float>>")
    def counted(texts: pa.Array) -> pa.Array:
        at, ns = [], []
        for _, data, offs in blocks(texts):
            first, f = features(data, offs)
            for i in range(len(offs) - 1):
                v, n = np.unique(f[first[i] : first[i + 1]], return_counts=True)
                at.append(v)
                ns.append(n.astype(np.float32))
        return pa.StructArray.from_arrays([pa.array(at, pa.list_(pa.int32())), pa.array(ns, pa.list_(pa.float32()))], names=["at", "n"])

    got = few.filter(F.col("k") <= each).select("lang", "h", counted("text").alias("f")).collect()
    got = [r for r in sorted(got, key=lambda r: (r["lang"], r["h"])) if r["f"]["at"]]
    x = np.zeros((len(got), DIM), np.float32)
    for i, r in enumerate(got):
        n = np.array(r["f"]["n"], np.float32)
        x[i, r["f"]["at"]] = 100 * n / n.sum()
    langs = np.array([r["lang"] for r in got])
    fams = np.array([family_of(v) for v in langs])
    model = Model(sorted(set(langs)), sorted(set(fams)))

    def pairs(label: np.ndarray, classes: list[str]) -> dict:
        out = {}
        for a, b in combinations(classes, 2):
            pick = (label == a) | (label == b)
            out[a, b] = _svm(x[pick], np.where(label[pick] == a, 1.0, -1.0))
        return out

    model.between = pairs(fams, model.families)
    for fam in model.families:
        model.within[fam] = pairs(langs, [v for v in model.langs if family_of(v) == fam])
    return model


def _vote(models: dict, classes: list[str], f: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winner (by votes, then by sum of margins, then by order) and its weakest logistic margin, by document."""
    n = len(first) - 1
    if len(classes) == 1:
        return np.zeros(n, int), np.ones(n)
    size = np.diff(first)
    votes, total, low = (np.zeros((n, len(classes))) for _ in range(3))
    low += 1
    at = np.minimum(first[:-1], max(len(f) - 1, 0))
    for (a, b), w in models.items():
        i, j = classes.index(a), classes.index(b)
        m = np.add.reduceat(w[f], at) if len(f) else np.zeros(n)
        m = np.where(size > 0, 100 * m / np.maximum(size, 1), 0) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(m, -30, 30)))
        votes[:, i] += m >= 0
        votes[:, j] += m < 0
        total[:, i] += m
        total[:, j] -= m
        low[:, i] = np.minimum(low[:, i], p)
        low[:, j] = np.minimum(low[:, j], 1 - p)
    best = np.lexsort((-total, -votes), axis=1)[:, 0] if n else np.zeros(0, int)
    return best, low[np.arange(n), best]


def predict(docs: DataFrame, model: Model, text: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with the struct column ``out`` of ``lang`` and ``score`` (0 to 1; it replaces a column of that name).

    Only the text is read, and all of it. ``lang`` is a learned language, or ``und`` with score 0 where the text is
    null or empty or has no letter, or nothing was learned. Rows are judged one by one: repeated rows agree, an
    empty table stays empty, other columns pass through.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang: string, score: double>")
    def judge(texts: pa.Array) -> pa.Array:
        m = shared.value
        langs, scores = [], []
        for _, data, offs in blocks(texts):
            n = len(offs) - 1
            if not m.langs:
                langs += ["und"] * n
                scores += [0.0] * n
                continue
            first, f = features(data, offs)
            fam, fp = _vote(m.between, m.families, f, first)
            lang, score = np.empty(n, object), np.zeros(n)
            for k, name in enumerate(m.families):
                own = np.flatnonzero(fam == k)
                if not len(own):
                    continue
                size = np.diff(first)[own]
                at = np.concatenate(([0], np.cumsum(size)))
                pick = np.repeat(first[own] - at[:-1], size) + np.arange(at[-1])
                classes = [v for v in m.langs if family_of(v) == name]
                best, p = _vote(m.within[name], classes, f[pick], at)
                lang[own] = np.array(classes, object)[best]
                score[own] = p * fp[own]
            langs += lang.tolist()
            scores += score.tolist()
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    guess = judge.asNondeterministic()(F.col(text))
    none = F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"))
    return docs.withColumn(out, guess).withColumn(out, F.when(F.col(text).rlike(r"\p{L}"), F.col(out)).otherwise(none))
