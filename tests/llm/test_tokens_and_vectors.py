"""Byte-level BPE against another library and a plain loop; vector codes against plain sums of squares."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from verdictlab.llm import bpe, queries, vector_codes

public = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def merges():
    return bpe.Merges(bpe.load_ranks(public.path("byte_bpe_multi_50k.tiktoken")), public.PATTERN)


@pytest.fixture(scope="module")
def other():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.load_ranks(public.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})


def texts(seed: int, n: int = 300) -> list:
    r = random.Random(seed)
    some = "aaaabth  \n\té'ls1234漢字ไทยéèñß😀!?.,  "
    return ["".join(r.choice(some) for _ in range(r.randrange(200))) for _ in range(n)]


EDGES = [None, "", " ", "a", "a" * 5000, " " * 3001, "é" * 2999, "ab" * 4000 + "'ll" * 50, "<|endoftext|>", "\x00\x01", "   x"]


@pytest.mark.parametrize("piece", [1 << 20, 40])
def test_ids_are_those_of_the_other_library(merges, other, monkeypatch, piece):
    monkeypatch.setattr(bpe, "PIECE", piece)
    rows = texts(piece) + EDGES
    assert merges.encode(pa.array(rows, pa.string())).to_pylist() == [other.encode_ordinary(t or "") for t in rows]


def test_a_small_cache_changes_nothing(merges, other, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    for seed in range(4):
        rows = texts(seed, 20)
        assert merges.encode(pa.array(rows)).to_pylist() == [other.encode_ordinary(t) for t in rows]


@pytest.mark.parametrize("seed", range(6))
def test_any_ranks_even_where_a_merge_makes_a_pair_of_lower_rank(seed):
    import tiktoken

    r = random.Random(seed)
    made = {"".join(r.choice("abc") for _ in range(r.randrange(2, 6))).encode() for _ in range(60)}
    listed = [*sorted(made, key=lambda _: r.random()), *[bytes([b]) for b in range(256)]]
    ranks = {t: i for i, t in enumerate(listed)}
    own = bpe.Merges(ranks, public.PATTERN)
    want = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = ["".join(r.choice("abc") for _ in range(r.randrange(1, 60))) for _ in range(200)]
    assert own.encode(pa.array(rows)).to_pylist() == [want.encode_ordinary(t) for t in rows]


def test_a_byte_without_a_token_is_refused():
    with pytest.raises(ValueError):
        bpe.Merges({b"a": 0}, public.PATTERN)


def test_other_columns_stay_and_broken_ids_stand_for_nothing(spark, merges):
    docs = spark.createDataFrame([(1, "one two", "x"), (1, "one two", "x"), (2, None, None)], "ids long, text string, decoded string")
    found = bpe.encode(docs, merges, out="tokens")
    assert found.columns == ["ids", "text", "decoded", "tokens"]
    got = bpe.decode(found, merges, ids="tokens").orderBy("ids").collect()
    assert [bytes(g["decoded"]) for g in got] == [b"one two", b"one two", b""]
    odd = spark.createDataFrame([([None, -5, 10**6],), (None,)], "ids array<int>")
    assert [bytes(r["decoded"]) for r in bpe.decode(odd, merges).collect()] == [b"", b""]
    assert bpe.decode(bpe.encode(docs.limit(0), merges, out="tokens"), merges, ids="tokens").count() == 0


def test_query_of_all_documents(spark, other):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = queries.op12_byte_bpe(spark, SF).collect()
    assert len(found) == len(docs)
    for r in found:
        ids = other.encode_ordinary(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


# --- vector codes


def plain_nearest(parts, entries):
    d = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1)


@pytest.mark.parametrize(("n", "dims", "width", "leaves"), [(0, 3, 4, 8), (1, 1, 3, 8), (300, 3, 4, 8), (700, 5, 3, 16), (500, 4, 2000, 512), (400, 2, 6, 1)])
def test_trie_finds_what_all_distances_find(monkeypatch, n, dims, width, leaves):
    monkeypatch.setattr(vector_codes, "LEAVES", leaves)
    r = np.random.default_rng(n)
    parts = np.unique(r.integers(-width, width, (n, dims)), axis=0)
    entries = r.integers(-width, width, (9, dims))
    code, error = vector_codes.nearest(parts, entries)
    if len(parts):
        want, low = plain_nearest(parts, entries)
        assert code.tolist() == want.tolist() and error.tolist() == low.tolist()


def plain(rows, n_parts=4, n_entries=256, rounds=4):
    v = [(k, [math.floor(1024 * x) for x in e]) for k, e in rows]
    size = len(v[0][1]) // n_parts
    books, codes = [], []
    for p in range(n_parts):
        x = np.array([e[p * size : (p + 1) * size] for _, e in v], np.int64)
        order = sorted((k, i) for i, (k, _) in enumerate(v) if k is not None)[:n_entries]
        c = x[[i for _, i in order]]
        for _ in range(rounds):
            own, _ = plain_nearest(x, c)
            c = np.array([(x[own == i].sum(axis=0) // (own == i).sum()) if (own == i).any() else c[i] for i in range(len(c))])
        own, d = plain_nearest(x, c)
        books.append(c)
        codes.append((own, d))
    return books, [("".join(f"{c[i]:02x}" for c, _ in codes), int(sum(d[i] for _, d in codes))) for i in range(len(v))]


def test_rounds_and_codes_against_plain_arithmetic(spark):
    r = random.Random(3)
    rows = [(i, [float(np.float32(r.gauss(0, 0.2))) for _ in range(8)], r.choice([None, 1, 2])) for i in range(400)]
    rows += [(1000 + i, rows[0][1], 1) for i in range(200)]  # a hot vector
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(7)
    books = vector_codes.train(df, n_entries=16)
    want, codes = plain([(k, e) for k, e, _ in rows], n_entries=16)
    assert [b.tolist() for b in books.entries] == [b.tolist() for b in want]
    coded = vector_codes.encode(df, books)
    found = {r["vec_id"]: (r["c"], r["error"]) for r in coded.select("vec_id", vector_codes.hex_code(coded["vector_code"]["code"]).alias("c"), "vector_code.error").collect()}
    assert found == {k: c for (k, _, _), c in zip(rows, codes, strict=True)}
    labels = vector_codes.label_errors(coded.select("vec_id", "label", "vector_code.error")).collect()
    for r in labels:
        assert r["label_error"] == sum(e for (_, _, lab), (_, e) in zip(rows, codes, strict=True) if lab == r["label"])
    near = vector_codes.decode(coded, books).collect()
    assert all(abs(sum((1024 * a - 1024 * b) ** 2 for a, b in zip(r["embedding"], r["approximation"], strict=True)) - r["vector_code"]["error"]) < 0.2 * (r["vector_code"]["error"] + 100) for r in near)


def test_vectors_that_are_left_out(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 3.0, 4.0], "a"), (2, None, "b"), (3, [1.0, None, 3.0, 4.0], "c"), (4, [nan, 2.0, 3.0, 4.0], "d"), (5, [1.0, -inf, 3.0, 4.0], "e"), (6, [], "f"), (7, [1.0] * 5, "g"), (8, [1.0] * 8, "h"), (None, [1.0, 2.0, 3.0, 5.0], None), (1, [1.0, 2.0, 3.0, 4.0], "a"), (9, [3e38, -3e38, 0.0, 0.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, vector_code string")
    books = vector_codes.train(df)
    assert len(books.entries[0]) == 3 and books.entries[0].max() == vector_codes.BOUND
    got = vector_codes.encode(df, books).select("vec_id", vector_codes.hex_code(vector_codes.F.col("vector_code")["code"]).alias("c")).collect()
    assert sorted((r["vec_id"] or 0, r["c"]) for r in got) == [(0, "00000000"), (1, "00000001"), (1, "00000001"), (9, "02020202")]
    none = vector_codes.train(df.limit(0))
    assert none.entries == [] and vector_codes.encode(df, none).count() == 0


def test_query_drops_nothing(spark):
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    found = queries.op13_vector_codes(spark, SF).collect()
    assert len(found) == n and len({r["codebooks_sha256"] for r in found}) == 1 and all(len(r["code"]) == 8 for r in found)
