"""The pipeline, stage by stage, on a small corpus with planted cases and edge rows."""

import random
from collections import Counter

import pytest

import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot string, id int"


@pytest.fixture
def corpus(spark, tmp_path):
    rng = random.Random(21)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n)) + "."
    item = prose(30)
    text = {i: prose(rng.randint(60, 200)) for i in range(60)}
    for i in (50, 51):
        text[i] = text[0]  # exact copies
    w = text[1].split()
    w[10] = "edited"
    text[52] = " ".join(w)  # a near copy
    text[53] = prose(60) + "\n" + item  # contaminated
    text[54] = " | ".join(vocab[:120])  # a menu
    text[55] = "too short"
    text[56] = text[2] + "\nHome | About | Shop | Contact"  # a failing line; then a copy of 2
    text[57] = prose(1500) + "\n" + item.upper() + "\n" + prose(20)  # under a twentieth: the span goes
    rows = [(i, t, "en", ["a", "b", None][i % 3], len(t), "own", i) for i, t in text.items()]
    rows += [(90, None, None, None, None, None, None), (91, "", "en", "a", 0, "", 0), (None, prose(80), "en", "a", 1, "x", 1), (92, text[3] + " " + prose(20000), "en", "c", 5, "x", 1)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 60, 2)] + [(None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), text, item


def test_stages(spark, corpus):
    d, text, item = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, kept = docs.columns, []
    for n, (_, stage) in enumerate(cp.STAGES):
        docs = stage(spark, docs, d)
        docs.write.parquet(f"{d}/out{n}")
        docs = spark.read.parquet(f"{d}/out{n}")
        kept.append({r["doc_id"]: r for r in docs.collect()})
        if n < 4:
            assert docs.columns == columns
    bad = {54, 55, 90, 91}
    assert set(kept[0]) == {*range(60), 92, None} - bad
    assert kept[0][56]["text"] == text[2] and kept[0][56]["n_chars"] == len(text[2]) and kept[0][4]["text"] == text[4]
    assert set(kept[1]) == set(kept[0]) - {50, 51, 52, 56}
    assert set(kept[2]) == set(kept[1]) - {53}
    assert item.upper()[:-1] not in kept[2][57]["text"] and kept[2][5]["text"] == text[5]
    assert set(kept[3]) <= set(kept[2])
    last = docs.collect()
    for s in {r["shard"] for r in last}:
        own = sorted(r["slot"] for r in last if r["shard"] == s)
        assert own == list(range(len(own)))
    assert Counter(r["doc_id"] for r in last) == Counter(r["doc_id"] for r in spark.read.parquet(f"{d}/out3").collect())
    assert max(Counter(r["doc_id"] for r in last if r["doc_id"] is not None).values()) <= 3


def test_run_equals_the_stages_and_takes_an_empty_table(spark, corpus):
    d, _, _ = corpus
    got = cp.run(spark, d)
    assert got.count() > 0 and {"shard", "slot"} <= set(got.columns)
    empty = spark.read.parquet(f"{d}/documents.parquet").filter("false")
    for _, stage in cp.STAGES:
        empty = stage(spark, empty, d)
        assert empty.count() == 0
