"""Mixing, sharding and the three dedups against plain versions, with edge rows."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verdictlab.llm import line_dedup, linking, mixing, near_dedup, sharding, substring_dedup

SIZE = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def norm(t):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))


def vocabulary(rng, n=400):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def prose(rng, vocab, n):
    return " ".join(rng.choice(vocab) for _ in range(n))


def water(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    cap = {s: most * sizes[s] for s in order}
    t, fixed = {}, set()
    while True:
        rest = sum(sizes.values()) - sum(cap[s] for s in fixed)
        open_ = [s for s in order if s not in fixed]
        total = sum(w[s] for s in open_)
        t = {s: cap[s] if s in fixed else rest * w[s] / total for s in order}
        over = {s for s in open_ if t[s] > cap[s] + 1e-9}
        if not over:
            return t
        fixed |= over


@pytest.mark.parametrize("seed", range(2))
def test_mixture(spark, seed):
    rng = random.Random(seed)
    sources = ["a", "b", "é", "", None, "tiny", "zero"]
    rows = []
    for i in range(400):
        s = rng.choice(sources[:5]) if i > 4 else "tiny"
        rows.append((i, "w " * rng.choice([1, 5, 40, rng.randint(0, 300)]), s, i))
    rows += [(500, None, "zero", 0), (501, "", "zero", 0), (None, "x y z", "a", 0), (600, "p q r", "a", 1), (600, "p q r", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 400, 3)] + [(3, 1), (None, 0)], "doc_id long, quality int")
    got = mixing.sizes(df.repartition(7), labels).collect()
    assert len(got) == len(rows)
    src = {r[0]: r[2] for r in rows}
    total = Counter()
    taken = Counter()
    for r in got:
        total[src[r["doc_id"]]] += r["size"]
        taken[src[r["doc_id"]]] += r["taken"]
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
    assert sum(total.values()) == sum(len(SIZE.findall(r[1] or "")) for r in rows)
    want = water(dict(total))
    for r in got:
        assert r["source_size"] == total[src[r["doc_id"]]] and abs(r["target"] - want[src[r["doc_id"]]]) < 1e-6
    for s in sources[:5]:
        assert abs(taken[s] - want[s]) <= max(5, 0.02 * want[s]), (s, taken[s], want[s])
    key = lambda rs: sorted((-1 if r["doc_id"] is None else r["doc_id"], r["copies"]) for r in rs)
    assert key(got) == key(mixing.sizes(df.repartition(3), labels).collect())
    mixed = mixing.mix(df, labels)
    assert mixed.columns == df.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({k: v for k, v in (Counter({}) + sum((Counter({r["doc_id"]: r["copies"]}) for r in got), Counter())).items() if v})
    assert mixing.sizes(df.filter("false"), labels).count() == 0 and mixing.mix(df.filter("false"), None).count() == 0


def test_empty_documents_of_a_tripled_source(spark):
    """Where whole epochs use up a budget, rows without words aren't taken once more."""
    rows = [(i, "w" if i % 2 else "", "small") for i in range(200)] + [(1000 + i, "w " * 100, "large") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.sizes(df, None).collect()
    assert {r["copies"] for r in got if r["doc_id"] < 200} == {3} and max(r["copies"] for r in got) <= 3


def test_a_very_long_text_is_sketched_in_pieces():
    x = np.random.default_rng(1).integers(0, 1 << 63, 3 * near_dedup.PIECE + 5, np.uint64)
    v = (x[None, :] ^ near_dedup._XOR[:, None]) * near_dedup._ODD[:, None]
    v ^= v >> np.uint64(29)
    at = np.sort(np.argsort(v, axis=1)[:, : near_dedup.MINIMA], axis=1)
    want = np.arange(near_dedup.SKETCHES, dtype=np.uint64) * np.uint64(near_dedup.MINIMA + 1) + np.uint64(near_dedup.MINIMA)
    for i in range(near_dedup.MINIMA):
        want = near_dedup.mix(want ^ x[at[:, i]])
    assert (near_dedup.sketch(x) == want).all()


def test_better_documents_are_drawn_first(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text"), F.when(F.col("id") < 2000, "a").otherwise("b").alias("source"))
    q = df.filter("doc_id >= 2000").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    got = mixing.sizes(df, q).filter("doc_id >= 2000").groupBy((F.col("doc_id") % 2).alias("q")).agg(F.sum("copies").alias("n"))
    n = dict(got.collect())
    assert n[1] > 2 * n[0] > 0


def test_shards(spark):
    rng = random.Random(1)
    v = vocabulary(rng)
    rows = [(i, prose(rng, v, rng.randint(0, 120)), "s") for i in range(900)]
    rows += [(1000 + i, "copy of the one text that a third of all rows hold", "s") for i in range(500)]
    rows += [(2000 + i, t, None) for i, t in enumerate([None, "", "é" * 50, "x " * 3000])] + [(2001, "", None)] * 2 + [(None, "no key", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = sharding.shard(df.repartition(6), 8).collect()
    assert len(got) == len(rows) and {r["law"] for r in got} == {"bytes"}
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    load, n = Counter(), Counter()
    for s in range(8):
        own = [r for r in got if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        load[s], n[s] = sum(r["size"] for r in own), len(own)
    assert max(load.values()) - min(load.values()) <= 0.03 * sum(load.values()) / 8
    again = sharding.shard(df.repartition(3), 8)
    assert Counter((r["doc_id"], r["shard"], r["text_crc32"]) for r in again.collect()) == Counter((r["doc_id"], r["shard"], r["text_crc32"]) for r in got)
    whole = sharding.shard_rows(df, 8)
    assert whole.columns == ["doc_id", "text", "shard", "slot"]
    assert Counter((r["doc_id"], r["shard"]) for r in whole.collect()) == Counter((r["doc_id"], r["shard"]) for r in got)
    assert sharding.shard(df.filter("false"), 8).count() == 0 and sharding.shard_rows(df.filter("false"), 8).count() == 0


def test_small_groups_stay_together(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 10000)).alias("text"))
    two = sharding.shard(df, 8).groupBy((F.col("doc_id") % 10000).alias("g")).agg(F.countDistinct("shard").alias("n")).filter("n > 1")
    assert two.count() == 0


def test_vector_packing():
    rng = np.random.default_rng(0)
    loads = rng.pareto(2, (500, 3)) + 0.1
    sums = np.array([loads[sharding.pack(loads, 8) == s].sum(0) for s in range(8)])
    assert (np.ptp(sums, axis=0) <= 0.15 * sums.mean(0)).all()
    assert len(sharding.pack(np.zeros((0, 3)), 8)) == 0


def similar(a, b):
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    x, y = grams(a), grams(b)
    both = sum((x & y).values())
    return both / (sum(x.values()) + sum(y.values()) - both)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(11)
    v = vocabulary(rng)
    docs, n = [], 0
    for _ in range(25):
        base = prose(rng, v, rng.choice([3, 30, 120, 300])).split()
        for _ in range(rng.choice([1, 2, 6])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 3, len(w) // 12])):
                if len(w) > 2:
                    k = rng.randrange(len(w))
                    w[k : k + 1] = rng.choice([[], [rng.choice(v)], [w[k], rng.choice(v)]])
            docs.append((n, (" ".join(w)).upper() + "." if n % 3 else " ".join(w)))
            n += 1
    docs += [(900, None), (901, ""), (902, "..."), (903, "..."), (904, "word " * 20000), (905, "word " * 20000), (0, docs[0][1]), (None, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("digest", F.lit(1)).withColumn("id", F.lit("x"))
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(df.repartition(5)).collect()}
    own = {i: norm(t) for i, t in docs if i is not None}
    assert set(got) == set(own)
    up = {i: i for i in own}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(own), 2):
        if own[a] and own[b] and similar(own[a], own[b]) >= 0.8:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    assert {i: r["class_id"] for i, r in got.items()} == {i: find(i) for i in own}
    assert {r["class_id"] for r in got.values()} == {i for i, r in got.items() if r["is_kept"]}
    kept = near_dedup.keep_one(df)
    assert sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == sorted([*[i for i in own if find(i) == i], 0])
    assert near_dedup.near_duplicates(df.filter("false")).count() == 0


def test_a_large_group_of_near_copies_is_one_class(spark):
    rng = random.Random(12)
    base = prose(rng, vocabulary(rng), 150).split()
    docs = [(0, " ".join(base))]
    for i in range(1, 400):
        w = list(base)
        for k in rng.sample(range(150), 2):
            w[k] = f"edit{i}x{k}"
        docs.append((i, " ".join(w)))
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(8))
    assert got.filter("class_id = 0").count() == 400


def test_alignment_is_ordered_and_banded():
    a = np.arange(100, dtype=np.uint32)
    assert near_dedup.alignment(a, a, 0.8) == 1.0
    assert near_dedup.alignment(a, np.roll(a, 50), 0.8) == 0.0
    b = np.delete(a, [10, 50])
    assert near_dedup.alignment(a, b, 0.8) == pytest.approx(0.98)
    c = a.copy()
    c[[3, 4]] = c[[4, 3]]
    assert near_dedup.alignment(a, c, 0.8) == pytest.approx(99 / 101)


def passages_hold(rows, got):
    """Every span stands earlier; every 50 words that stand earlier have a span; whole lines and texts as a set."""
    texts = sorted({(i, h, t) for i, h, t in rows})
    words = {(i, h): [(m.group(), m.start(), m.end()) for m in WORD.finditer("".join(c.lower() if c.isascii() else c for c in t))] for i, h, t in texts}
    spans = {}
    for r in got:
        spans.setdefault((r["doc_id"], r["text_hash"]), []).append(r)
    seen50, seen17, lines = set(), set(), set()
    for i, h, t in texts:
        w = words[i, h]
        own = spans.get((i, h), [])
        new17, at = [], 0
        repeated_line = [False] * len(w)
        for line in t.split("\n"):
            n = len(norm(line))
            k = tuple(x[0] for x in w[at : at + n])
            if n and k in lines:
                repeated_line[at : at + n] = [True] * n
            lines.add(k)
            at += n
        covered = [any(r["start"] <= x[1] and x[2] <= r["end"] for r in own) for x in w]
        assert all(c for c, f in zip(covered, repeated_line, strict=True) if f)
        fine = list(repeated_line)
        for k in range(len(w) - 16):
            x = tuple(y[0] for y in w[k : k + 17])
            if x in seen17:
                fine[k : k + 17] = [True] * 17
            seen17.add(x)
        whole = any(r["kind"] == "text" for r in own)
        assert whole or all(f for c, f in zip(covered, fine, strict=True) if c)
        for k in range(len(w) - 49):
            x = tuple(y[0] for y in w[k : k + 50])
            assert x not in seen50 or any(covered[k : k + 50])
            seen50.add(x)
        for r in own:
            assert len(norm(t[r["start"] : r["end"]])) == r["n_words"]


@pytest.mark.parametrize("letters", [12, 60, 700])
def test_a_passage_of_long_words_is_covered_whole(spark, letters):
    rng = np.random.default_rng(letters)
    word = lambda: "".join(rng.choice(list("abcdefgh"), letters))
    passage = " ".join(word() for _ in range(60))
    rows = [(i, f"{word()} {word()} {passage} {word()} {word()}") for i in range(3)]
    got = sorted((r["doc_id"], r["start"], r["end"], r["n_words"], r["first_doc_id"]) for r in substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    start = 2 * letters + 2
    assert got == [(i, start, start + len(passage), 60, 0) for i in (1, 2)]


def test_repeated_passages_hold_against_brute_force(spark):
    rng = random.Random(13)
    v = vocabulary(rng)
    shared = [prose(rng, v, rng.choice([8, 20, 50, 51, 60, 120])) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            own = rng.choice([prose(rng, v, rng.randint(1, 60)), rng.choice(shared)])
            cut = own.split()
            k = rng.randint(0, len(cut))
            parts.append(rng.choice([own, own.upper(), " ".join(cut[:k]), " ".join(cut[k:]), own.replace(" ", ", ", 3), own.replace(" ", "\n", 1)]))
        rows.append((i, rng.choice(["\n", " ", "é "]).join(parts)))
    rows += [(60, rows[3][1]), (60, rows[4][1]), (60, rows[4][1]), (61, "a " * 3000), (62, "x y " * 900), (63, "a " * 2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    h = {(r["doc_id"], r["text"]): r["h"] for r in df.select("*", F.xxhash64("text").alias("h")).collect()}
    got = substring_dedup.repeated_spans(df.repartition(5)).collect()
    passages_hold([(i, h[i, t], t) for i, t in rows], got)
    assert len({(r["doc_id"], r["text_hash"], r["start"]) for r in got}) == len(got)


def test_a_short_line_in_many_documents(spark):
    rng = random.Random(14)
    v = vocabulary(rng)
    line = prose(rng, v, 10)
    df = spark.createDataFrame([(i, f"{prose(rng, v, 30)}\n{line}\n{prose(rng, v, 9)}") for i in range(50)], "doc_id long, text string")
    got = substring_dedup.repeated_spans(df).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(1, 50)) and {(r["kind"], r["n_words"], r["first_doc_id"]) for r in got} == {("line", 10, 0)}
    assert substring_dedup.repeated_spans(df, min_line_words=11).count() == 0


def test_passages_set_into_lines(spark):
    rng = random.Random(15)
    v = vocabulary(rng)
    passage = prose(rng, v, 51)
    docs = {i: prose(rng, v, 80) for i in range(30)}
    for i in (3, 9, 25):
        w = docs[i].split()
        docs[i] = " ".join([*w[:30], passage, *w[30:]])
    rows = [*docs.items(), (40, None), (41, ""), (42, "!!"), (None, passage), (43, docs[7]), (43, docs[7])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("x")).withColumn("no", F.lit(1)).withColumn("h", F.lit(0))
    spans = substring_dedup.repeated_spans(df.repartition(4))
    got = {r["doc_id"]: r for r in spans.collect()}
    assert sorted(got) == [9, 25, 43] and spans.count() == 3
    for i in (9, 25):
        r = got[i]
        assert passage in docs[i][r["start"] : r["end"]] and r["n_words"] <= 53 and (r["kind"], r["first_doc_id"]) == ("passage", 3)
    assert (got[43]["kind"], got[43]["first_doc_id"]) == ("text", 7)
    clean = {r["doc_id"]: r for r in substring_dedup.remove_spans(df.filter("doc_id < 40"), spans).collect()}
    assert clean[3]["text"] == docs[3] and clean[0]["text"] == docs[0] and clean[0]["removed_spans"] == []
    assert passage not in clean[9]["text"] and len(clean[9]["removed_spans"]) == 1
    assert substring_dedup.repeated_spans(df.filter("false")).count() == 0


def test_fuzzy_lines_equal_brute_force(spark):
    rng = random.Random(14)
    v = vocabulary(rng)
    pool = [prose(rng, v, rng.choice([1, 4, 12, 40])) for _ in range(25)]
    docs = []
    for i in range(40):
        lines = []
        for _ in range(rng.randint(0, 6)):
            x = rng.choice(pool)
            if rng.random() < 0.5:
                k = rng.randrange(len(x))
                x = x[:k] + rng.choice("xyz ") + x[k + rng.randint(0, 1) :]
            lines.append(rng.choice(["", x, x.upper(), "  " + x]))
        docs.append((i, "\n".join(lines)))
    docs += [(90, None), (91, "\n\n"), (92, "é😀 " * 5 + "\nend"), (93, "a" * 50000), (0, docs[0][1]), (None, pool[0])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("keys", F.lit(1))
    got = {(r["doc_id"], r["line_no"]): r for r in line_dedup.fuzzy_lines(df.repartition(5)).collect()}
    fold = lambda b: bytes(c + 32 if 65 <= c < 91 else c for c in b if c not in b" \t\n\x0b\x0c\r")
    lines = {(i, n): fold(x.encode()) for i, t in docs if i is not None for n, x in enumerate((t or "").split("\n")) if fold(x.encode())}
    assert set(got) == set(lines)
    for (i, n), r in got.items():
        t = dict(d for d in docs if d[0] is not None)[i]
        assert t[r["start"] : r["end"]] == t.split("\n")[n]
    sets = {f: {f[k : k + 8] for k in range(max(1, len(f) - 7))} for f in lines.values()}
    up = {f: f for f in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            up[find(a)] = find(b)
    first = {}
    for k in sorted(lines):
        first.setdefault(find(lines[k]), k)
    wrong = [k for k, r in got.items() if (r["kept_doc_id"], r["kept_line_no"]) != first[find(lines[k])]]
    assert not wrong
    clean = dict(line_dedup.remove_lines(df.filter("doc_id < 40").select("doc_id", "text").distinct(), line_dedup.fuzzy_lines(df)).collect())
    for i, t in docs[:40]:
        assert clean[i] == "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in got or got[i, n]["is_kept"])
    assert line_dedup.fuzzy_lines(df.filter("false")).count() == 0


def test_lines_that_share_only_the_last_bands_are_linked(spark):
    """Pairs of a Jaccard similarity of 0.8 to 0.86 that share no bucket of the first eight bands."""
    pairs = [
        ("eclzxxhytobxthmevecizkuajpebtcloedmnscyijaigyccalwmnkryzzuhgzxzbozhnnn", "ecl0xxhytobxthmevecizkuajpebtcloedmnscyijaigyccalwmnkryzzuhgzxzbozh1nn"),
        ("njhseqbgiqqctbdyxkerevkctkewqattshdnronyyfyujyqdskiphsbeugajbrmybspzdm", "n0hseqbgiqqctbdyxkerevkctkewqattshdnronyyfyujyqdskiphsbeugajbrmybsp1dm"),
        ("qrtspxzctexmlmhlwacmrfbegvxbqgoabidzzlvdyqxemtuswokmcpigmhpkqttvcvezzm", "qr0spxzctexmlmhlwacmrfbegvxbqgoabidzzlvdyqxemtuswokmcpigmhpkqttvcve1zm"),
    ]
    df = spark.createDataFrame([(10 * i + j, x) for i, p in enumerate(pairs) for j, x in enumerate(p)], "doc_id long, text string")
    got = {r["doc_id"]: r["kept_doc_id"] for r in line_dedup.fuzzy_lines(df).collect()}
    assert got == {k: k // 10 * 10 for k in got} and len(got) == 6


def test_lines_unlike_their_leader_are_linked(spark, monkeypatch):
    """All lines share all buckets, so there is one leader; two others are similar to each other but not to it."""
    rng = random.Random(15)
    v = vocabulary(rng)
    a = prose(rng, v, 30)
    texts = [prose(rng, v, 30) for _ in range(20)] + [a, a + " end"]

    digests = [r[0]["digest"] for r in line_dedup._Lines()(pa.array(texts)).to_pylist()]
    assert digests.index(min(digests)) < 20  # the leader, as all meet equally often

    def same_keys(t: pa.Array) -> pa.Array:
        made = line_dedup._Lines()(t)
        return pa.array([[x | {"keys": x["keys"] and [7] * 10} for x in r] for r in made.to_pylist()], made.type)

    monkeypatch.setattr(line_dedup, "_lines", lambda: same_keys)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["kept_doc_id"] for r in line_dedup.fuzzy_lines(df).collect()}
    assert got == {i: 20 if i == 21 else i for i in range(22)}


def test_lines_without_a_partner_are_not_shuffled_for_the_result(spark, tmp_path):
    """Only lines that stand twice or more, or are like another one, go through an exchange and a join; documents given twice too."""
    rng = random.Random(16)
    v = vocabulary(rng)
    texts = ["\n".join(prose(rng, v, 12) for _ in range(10)) for _ in range(120)]
    like = prose(rng, v, 40)
    texts += [like, like + " x", texts[3].split("\n")[0]]
    df = spark.createDataFrame([*enumerate(texts), (5, texts[5])], "doc_id long, text string")
    out = line_dedup.fuzzy_lines(df)
    got = {(r["doc_id"], r["line_no"]): (r["kept_doc_id"], r["kept_line_no"], r["is_kept"]) for r in out.collect()}
    other = {(121, 0): (120, 0, False), (122, 0): (3, 0, False)}
    assert got == {(i, n): other.get((i, n), (i, n, True)) for i, t in enumerate(texts) for n in range(len(t.split("\n")))}
    assert out.count() == len(got)

    plan = out._jdf.queryExecution().executedPlan()
    sent = []

    def visit(p):
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return visit(p.executedPlan())
        if p.getClass().getSimpleName().endswith("QueryStageExec"):
            return visit(p.plan())
        if p.metrics().contains("shuffleRecordsWritten"):
            sent.append(p.metrics().apply("shuffleRecordsWritten").value())
        kids = p.children()
        for i in range(kids.size()):
            visit(kids.apply(i))

    visit(plan)
    assert sum(sent) < 200  # of 1,203 lines


def test_groups_that_fit_a_shard_stay_whole(spark):
    """A hundredth of all rows in one group, and pairs in a table of fewer rows than there are bundles."""
    g = F.when(F.col("id") < 20, -1).otherwise(F.col("id") % 1000)
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), g).alias("text"), g.alias("g"))
    got = sharding.shard(df, 8).join(df.select("doc_id", "g"), "doc_id").cache()
    assert got.groupBy("g").agg(F.countDistinct("shard").alias("n")).filter("n > 1").count() == 0
    load = [r["x"] for r in got.groupBy("shard").agg(F.sum("size").alias("x")).collect()]
    assert len(load) == 8 and max(load) - min(load) <= 0.03 * sum(load) / 8


def test_groups_are_cut_only_where_they_must():
    fine = np.ones((800, 3))
    pieces = np.full((40, 3), 5.0)
    both = sharding.pack_groups(np.concatenate((fine, pieces[:16])), np.array([str(i) for i in range(800)] + ["g"] * 16), 8)
    assert len(set(both[800:])) == 1
    over = sharding.pack_groups(np.concatenate((fine, pieces)), np.array([str(i) for i in range(800)] + ["g"] * 40), 8)
    assert len(set(over[800:])) > 1
    assert len(sharding.pack_groups(np.zeros((0, 3)), np.zeros(0, str), 8)) == 0


def test_shared_keys_are_counted_from_packed_runs(spark, monkeypatch):
    """As by a group-by of a row a key, but with few rows shuffled, whether or not a task adds up in between."""
    r = np.random.default_rng(11)
    data = [(int(r.integers(-50, 400)), [*r.integers(-9000, 9000, r.integers(0, 9)).tolist(), 7, -(1 << 62)]) for _ in range(2000)]
    df = spark.createDataFrame([*data, (5, None), (6, [])], "id long, keys array<long>").coalesce(2)
    ids = {}
    for i, keys in data:
        for k in keys:
            ids.setdefault(k, []).append(i)
    for dealt in (linking.DEALT, 300):
        monkeypatch.setattr(linking, "DEALT", dealt)
        out = linking._shared(df)
        got = {x["key"]: (x["lo"], x["hi"], x["n"]) for x in out.collect()}
        assert got == {k: (min(x), max(x), len(x)) for k, x in ids.items() if min(x) < max(x)}
        if dealt > 300:
            parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
            plan = out._jdf.queryExecution().executedPlan().executedPlan()
            while not plan.metrics().contains("shuffleRecordsWritten"):
                plan = plan.plan() if plan.getClass().getSimpleName().endswith("QueryStageExec") else plan.children().apply(0)
            assert plan.metrics().apply("shuffleRecordsWritten").value() <= 2 * 2 * 4 * parts  # of some 12,000 keys
    assert linking._shared(df.filter("false")).count() == 0


def test_lines_are_the_same_in_small_blocks_and_with_bytes_that_are_no_text(monkeypatch):
    texts = ["Abc dé\n\n \tx\n😀 Long enough line\n", None, "", "plain ASCII text here\nplain ascii TEXT here", "\0\n é"] * 3
    whole = line_dedup._Lines()(pa.array(texts)).to_pylist()
    monkeypatch.setattr(line_dedup, "BLOCK", 1)
    assert line_dedup._Lines()(pa.array(texts)).to_pylist() == whole
    assert [(x["no"], x["start"], x["end"], x["folded"]) for x in whole[0]] == [(0, 0, 6, "abcdé"), (2, 8, 11, "x"), (3, 12, 30, "😀longenoughline")]
    assert [x["folded"] for x in whole[3]] == ["plainasciitexthere", None] and whole[3][0]["digest"] == whole[3][1]["digest"]
    bad = pa.array([b"\x80abc \xff", b"fine"]).view(pa.string())
    got = line_dedup._Lines()(bad).to_pylist()
    assert [(x["start"], x["end"], x["folded"]) for r in got for x in r] == [(0, 6, "\ufffdabc\ufffd"), (0, 4, "fine")]
    twice = line_dedup._similarity(pa.array(["abcabcabcabc", "short"]), pa.array(["abcabcabc", "Short"]))
    assert twice.to_pylist() == [2 / 3, 0.0]


def test_a_sieve_loses_nothing(spark):
    r = np.random.default_rng(8)
    mine, other = (r.integers(-(1 << 63), (1 << 63) - 1, 3000) for _ in range(2))
    one, some = linking.sieve(spark.createDataFrame([(int(x),) for x in mine], "x long"))
    df = spark.createDataFrame([(i, int(a), [int(b), int(a), int(b)]) for i, (a, b) in enumerate(zip(mine, other, strict=True))], "i int, x long, xs array<long>")
    got = df.withColumn("kept", some("xs")).filter(one("x")).collect()
    assert len(got) == 3000 and all(g["x"] in g["kept"] for g in got)
    assert sum(len(g["kept"]) for g in got) < 3010  # others pass by chance only


def test_sets_differ_in_no_fewer_tokens_than_parity_bits():
    r = np.random.default_rng(9)
    sets = [set(r.integers(0, 1 << 32, int(n)).tolist()) for n in r.integers(1, 60, 40)] + [set()]
    sets += [set(list(s)[1:]) | {7} for s in sets]
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    bits = linking._parity(np.array([x for s in sets for x in s], np.int64), row, len(sets))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert sum(int(x ^ y).bit_count() if x ^ y >= 0 else int((x ^ y) & np.int64((1 << 63) - 1)).bit_count() + 1 for x, y in zip(bits[i], bits[j], strict=True)) <= len(a ^ b)
    assert len(linking._parity(np.zeros(0, np.int64), np.zeros(0, np.int64), 0)) == 0


def test_rows_of_a_prefix_without_a_partner_are_left_out_and_no_pair_is(spark):
    r = random.Random(13)
    rows = []
    for i in range(400):
        tok = r.randrange(40)
        size = 40 + 5 * (tok % 7) + r.choice([0, 0, 1, 2, 9])
        rows.append((i, r.randrange(3), size, tok, size - r.randrange(int(0.2 * size) + 1)))
    rows.append((1000, 7, 50, 99, 41))
    rows.append((1001, 8, 50, 99, 41))  # too few left in both, for sets of 50 share 45 at least
    rows += [(1002, 7, 50, 98, 50), (1003, 7, 50, 98, 50)]  # one class
    df = spark.createDataFrame(rows, "id long, c long, size int, tok long, left int")
    got = {x["id"]: x["blocks"] for x in linking._paired(df, 0.8).collect()}
    fits = lambda a, b: min(a[4], b[4]) >= np.ceil(0.8 / 1.8 * (a[2] + b[2]) - 1e-9)
    needed = {a[0] for a in rows for b in rows if a[3] == b[3] and a[1] != b[1] and fits(a, b)}
    assert needed <= set(got) and set(got.values()) == {1}
    assert len(got) < 0.8 * len(rows) and not {1000, 1001, 1002, 1003} & set(got)


def test_rarity_is_counted_in_the_tasks_and_by_class(spark):
    r, cells = random.Random(12), linking.CELLS
    data = [(i, i % 3, [r.randrange(-(2**62), 2**62) for _ in range(9)] + [5, 5 + cells, -7] * (i % 3 > 0) + [11] * (i % 3 == 0)) for i in range(300)]
    got = linking._rarity(spark.createDataFrame(data, "id long, c long, toks array<long>").repartition(4))
    n, of = Counter(), {}
    for _, c, toks in data:
        for t in toks:
            n[t % cells] += 1
            of.setdefault(t % cells, set()).add(c)
    assert {int(x): int(got[x]) for x in np.flatnonzero(got)} == {x: k for x, k in n.items() if len(of[x]) > 1}
    assert got[5] == 400 and got[-7 % cells] == 200 and got[11] == 0  # what one class alone has isn't sent


def test_the_exact_finish_makes_few_pairs_of_unlike_sets(spark):
    r = np.random.default_rng(10)
    sets = {i: set(r.choice(60, 36, replace=False).tolist()) for i in range(300)}  # they share their tokens, but are unlike
    sets[300], sets[301] = sets[0] ^ {0}, sets[1] ^ {1, 2}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, toks array<long>")
    made = []

    def verify(pairs):
        made.extend(tuple(p) for p in pairs.select("a", "b").collect())
        like = [(a, b) for a, b in made if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
        return spark.createDataFrame(like, "a long, b long")

    none = spark.createDataFrame([], "node long, component long")
    got = linking._finish(df.select("id", F.col("id").alias("c")), none, verify, lambda ids: df.join(ids, "id"), 0.8)
    found = {r["node"]: r["component"] for r in got.collect()}
    want = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert {(0, 300), (1, 301)} <= set(want) and all(found[a] == found[b] for a, b in want)
    assert set(want) <= set(made) and len(made) < 100  # of 45,451
