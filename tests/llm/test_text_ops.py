"""Quality rules, language ID, decontamination, secrets and URLs against plain versions, with edge rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verdictlab.llm import decontam, lang_id, quality, secret_scan, url_filter

EDGE = [(1, "x"), (2, None), (3, ""), (4, " \n\t "), (None, "null key"), (5, "word " * 30000), (1, "x"), (6, "\u00e9\u00df 漢字 😀\u2028 \x00 z"), (7, ".\n..\n.")]


def edge(spark, extra=()):
    """Edge rows, with extra columns that clash with the operators' own names."""
    df = spark.createDataFrame([*EDGE, *extra], "doc_id long, text string")
    return df.withColumn("lang", F.lit("en")).withColumn("source", F.lit(None).cast("string")).withColumn("spans", F.lit(1)).withColumn("h", F.lit("h")).withColumn("size", F.lit("s")).withColumn("id", F.lit(0))


def english(rng, n):
    words = ["the", "river", "stone", "under", "morning", "people", "walked", "along", "quiet", "garden", "before", "letter", "seven", "harbour"]
    return " ".join(rng.choice(words) + ("." if rng.random() < 0.1 else "") for _ in range(n)) + "."


def test_quality_base_equals_a_plain_version(spark):
    rng = random.Random(2)
    texts = ["", "a b a b a b", "x\nx\n\ny\nx", "# $ | < é", "\x1f\u00a0 a", *[" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(40)], *["\n".join(rng.choice(["l m n", "o", " "]) for _ in range(30)) for _ in range(5)]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    word = re.compile(r"[^\x20\x09-\x0D]+")
    for r in quality.line_rules(df).collect():
        t = texts[r["doc_id"]]
        w = word.findall(t)
        lines = [x for x in t.split("\n") if word.search(x)]
        win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        hit = {j for i, x in enumerate(win) if win.count(x) > 1 for j in range(i, i + 3)}
        q = r["line_rules"]
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)), t
        assert q["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w))


def test_quality_verdicts(spark):
    rng = random.Random(3)
    good = english(rng, 120)
    menu = " | ".join(english(rng, 1) for _ in range(80))
    shout = " ".join(w.upper() + "!!" for w in english(rng, 120).split())
    mixed = good + "\n" + "Home | About | Shop | Contact"
    df = spark.createDataFrame([(1, good), (2, menu), (3, shout), (4, mixed), (5, good + "\n" + good + " x")], "doc_id long, text string")
    got = {r["doc_id"]: r["line_rules"] for r in quality.line_rules(df).collect()}
    assert [got[i]["kept"] for i in (1, 2, 3, 4)] == [True, False, False, True]
    assert got[1]["text"] == good and got[4]["text"] == good and got[4]["removed_lines"] == [1]


def test_quality_edges(spark):
    got = quality.line_rules(edge(spark)).collect()
    assert len(got) == len(EDGE) and not any(r["line_rules"]["kept"] for r in got)
    assert next(r for r in got if r["doc_id"] == 5)["line_rules"]["n_repeat_words"] == 30000
    assert quality.line_rules(edge(spark).filter("false")).count() == 0


def test_quality_of_a_very_long_text(spark):
    """Three million words in a line, and as many in short lines: whole texts, in bounded memory."""
    words = " ".join(f"word{i % 70001}." for i in range(3_000_000))
    df = spark.createDataFrame([(1, words), (2, words.replace(". ", ".\n"))], "doc_id long, text string")
    got = {r["doc_id"]: r["line_rules"] for r in quality.line_rules(df, with_text=False).collect()}
    assert got[1]["n_words"] == got[2]["n_words"] == got[1]["n_repeat_words"] == 3_000_000 and got[1]["base_failed"]
    assert got[2]["n_dup_lines"] == 3_000_000 - 70001


def test_languages(spark):
    rng = random.Random(5)
    words = {"en": "the and with from that this have over".split(), "de": "der und mit von dass diese haben über".split(), "fr": "le et avec de que cette avoir sur été".split(), "es": "el y con de que esta haber sobre más".split()}
    make = lambda k: " ".join(rng.choice(words[k]) for _ in range(60))
    train = spark.createDataFrame([(i, make(k), k) for i, k in enumerate(list(words) * 12)], "doc_id long, text string, lang string")
    model = lang_id.fit(train)
    assert model.families == ["germanic", "romance"] and set(model.within["romance"]) == {("es", "fr")}
    test = spark.createDataFrame([(i, make(k), k) for i, k in enumerate(list(words) * 10)], "doc_id long, text string, lang string")
    got = lang_id.predict(test, model).collect()
    assert sum(r["lang"] == r["language"]["lang"] for r in got) >= 39
    assert all(0 <= r["language"]["score"] <= 1 for r in got)
    again = lang_id.predict(test.drop("lang", "doc_id").repartition(3), lang_id.fit(train.repartition(5)))
    assert {r["text"]: r["language"]["lang"] for r in again.collect()} == {r["text"]: r["language"]["lang"] for r in got}
    e = {(r["doc_id"], r["text"]): r["language"] for r in lang_id.predict(edge(spark), model).collect()}
    assert [e[k]["lang"] for k in ((2, None), (3, ""), (4, " \n\t "), (7, ".\n..\n."))] == ["und"] * 4 and e[1, "x"]["lang"] in words
    none = lang_id.fit(train.filter("false"))
    assert {r["language"]["lang"] for r in lang_id.predict(edge(spark), none).collect()} == {"und"}
    one = lang_id.fit(train.filter("lang = 'de'"))
    assert lang_id.predict(edge(spark).filter("doc_id = 1"), one).first()["language"]["lang"] == "de"


def windows_by_hand(words, items, w=13):
    hit, met = set(), set()
    for k, own in items:
        m = min(w, len(own))
        wins = {tuple(own[i : i + m]) for i in range(len(own) - m + 1)} if own else set()
        for i in range(len(words) - m + 1):
            if wins and tuple(words[i : i + m]) in wins:
                met.add(str(k))
                hit.update(range(i, i + m))
    return len(hit), met


@pytest.mark.parametrize("blocks", [2_000_000, 40])
def test_decontamination_equals_windows(spark, blocks):
    rng = random.Random(7)
    vocab = ["a", "B", "c", "Dé", "e1"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 3, 5, 13, 14, 25])))) for i in range(12)]
    items += [(90, None), (None, "a a a"), (91, "?!"), (92, items[5][1])]
    docs = []
    for i in range(60):
        t = [rng.choice([*vocab, "zz", "q"]) for _ in range(rng.randint(0, 40))]
        src = items[rng.randint(0, 11)][1].split()
        docs.append((i, (", " if i % 2 else "\n").join([*t[:9], *src[: rng.randint(0, 30)], *t[9:]])))
    df, it = edge(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    got = decontam.match(df, it, max_words=blocks).withColumn("n", decontam.n_hit()).withColumn("bad", decontam.contaminated()).withColumn("sha", decontam.items_digest())
    toks = lambda t: [x.decode() for x in decontam.tokens((t or "").encode())]
    own = [(k, toks(t)) for k, t in items if k is not None and t is not None]
    for r in got.collect():
        words = toks(r["text"])
        n, met = windows_by_hand(words, own)
        assert (r["contamination"]["n_words"], r["n"], set(r["contamination"]["items"])) == (len(words), n, met), r["text"]
        assert r["bad"] == (n > 0 and 20 * n >= len(words))
        assert r["sha"] == hashlib.sha256(",".join(sorted(met)).encode()).hexdigest()


def test_decontamination_cuts_spans(spark):
    item = " ".join(f"w{i}" for i in range(15))
    long = "Intro, " * 400 + item.upper() + ". The end"
    docs = spark.createDataFrame([(1, long), (2, "short " + item), (3, "clean text"), (4, None)], "doc_id long, text string")
    got = dict(decontam.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect())
    assert set(got) == {1, 3, 4} and got[1] == "Intro, " * 400 + ". The end" and got[3] == "clean text"
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(docs, none).count() == 4
    assert decontam.decontaminate(docs.filter("false"), none).count() == 0


ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def base_by_hand(t):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(found)


def test_secrets(spark):
    rng = random.Random(9)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    texts = [
        "password:token:abcdefgh", "Token = 'abc' secret=abcdef API_KEY: \"x.y=z/1\"", "AKIA" + "A" * 16 + " AKIAAKIA" + "B" * 15, "é😀 " + "0123456789abcdef" * 2,
        "a" * 23, "a" * 24 + "g" + "b" * 30, "toKen=ſecret1 \u212aey", f"the value {key} here", "quietgardenletters and walked_along_the_river_before", "4111111111111111",
        *["".join(rng.choice(["token", "secret", "=", ":", " ", "'", "ab", "AKIA", "0f", "Z9"]) for _ in range(40)) for _ in range(60)],
    ]
    docs = spark.createDataFrame([(i, english(rng, 80)) for i in range(60)], "doc_id long, text string")
    ratios = secret_scan.train(secret_scan.samples(docs))
    df = edge(spark, [(100 + i, t) for i, t in enumerate(texts)])
    got = secret_scan.scan(df, ratios).withColumn("l", secret_scan.listed(F.col("secrets.spans"))).collect()
    for r in got:
        assert [tuple(x) for x in r["secrets"]["base"]] == base_by_hand(r["text"] or ""), r["text"]
        assert {tuple(x) for x in r["secrets"]["base"]} <= {tuple(x) for x in r["secrets"]["spans"]}
    by = {r["doc_id"]: r["l"] for r in got}
    assert by[107] == "markov:10:50" and by[108] == by[109] == by[2] == ""
    assert secret_scan.scan(df.filter("false"), ratios).count() == 0
    none = secret_scan.train(secret_scan.samples(docs.filter("false")))
    assert secret_scan.scan(df.filter("doc_id = 107"), none).select(F.size("secrets.spans")).first()[0] == 0
    plan = secret_scan.scan(df, ratios)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plain_markov(labelled, smooth=0.5):
    """Transition counts and log ratios, token by token."""
    k, n = len(secret_scan.ALPHABET), Counter()
    for token, random_ in labelled:
        n.update((random_, a, b) for a, b in zip(token, token[1:]) if a in secret_scan.ALPHABET and b in secret_scan.ALPHABET)
    ratio = {}
    for a in secret_scan.ALPHABET:
        total = {z: sum(n[z, a, b] for b in secret_scan.ALPHABET) + smooth * k for z in (True, False)}
        for b in secret_scan.ALPHABET:
            ratio[a, b] = math.log((n[True, a, b] + smooth) / total[True]) - math.log((n[False, a, b] + smooth) / total[False])
    return lambda t: sum(ratio[x] for x in zip(t, t[1:])) / (len(t) - 1)


def test_planted_keys(spark):
    """Keys of several alphabets without a keyword in front, among ordinary identifiers; and the models by hand."""
    rng = random.Random(21)
    alphabets = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdefghijklmnopqrstuvwxyz", secret_scan.ALPHABET[:-4], secret_scan.ALPHABET[:-1]]
    docs = [(i, english(rng, 80)) for i in range(80)]
    keys, plain = [], []
    for i in range(60):
        own = "".join(rng.choice(alphabets[i % 4]) for _ in range(rng.randint(28, 44))).strip("=")
        word = rng.choice("_-").join(english(rng, 6).replace(".", "").split())
        docs.append((100 + i, f"{english(rng, 10)} {own} {english(rng, 10)} {word} end"))
        keys.append(own), plain.append(word)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labelled = secret_scan.samples(df.filter("doc_id < 100")).cache()
    model = secret_scan.train(labelled)
    by_hand = plain_markov([(r["token"], r["random"]) for r in labelled.collect()])
    scored = spark.createDataFrame([(t,) for t in keys + plain], "t string").select("t", secret_scan.score(F.col("t"), model.ratios).alias("s")).collect()
    assert all(r["s"] == pytest.approx(by_hand(r["t"]), abs=1e-4) for r in scored)
    found = set()
    for r in secret_scan.scan(df.filter("doc_id >= 100"), model).collect():
        found |= {r["text"][x["start"] : x["end"]] for x in r["secrets"]["spans"]}
    assert len(found & set(keys)) >= 0.95 * len(keys) and not found & set(plain)


def test_many_matches_in_one_text(spark):
    text = " ".join(f"token={'ab' * 4}{i} AKIA{'Z' * 16}{i}" for i in range(600))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = df.select(secret_scan.base_spans(F.col("text")).alias("s")).first()["s"]
    assert [tuple(x) for x in got] == base_by_hand(text)


RULES = [url_filter.Rule("org", "/", "allow"), url_filter.Rule("example.org", "/es/", "block"), url_filter.Rule("com", "/de/", "block")]


def test_urls(spark):
    cases = {
        "http://A.Example.ORG/es/x?q#f": ("a.example.org", "/es/x", "example.org/es/", "block"), "https://org": ("org", "", None, None), "x://org/": ("org", "/", "org/", "allow"),
        "no scheme": ("", "", None, None), None: ("", "", None, None), "http://notorg/a": ("notorg", "/a", None, None), "a://b.com/de/?://c": ("b.com", "/de/", "com/de/", "block"),
        "http://ÄB.com#x/de/": ("Äb.com", "", None, None), "http://": ("", "", None, None), "q\n://h\n.com/p\n?": ("h\n.com", "/p\n", None, None),
    }
    df = spark.createDataFrame([(i, u, "own") for i, u in enumerate(cases)], "page_id long, url string, verdict string")
    got = {r["url"]: r for r in url_filter.filter_urls(df, RULES).collect()}
    for u, (host, path, rule, verdict) in cases.items():
        r = got[u]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), u
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    empty = url_filter.filter_urls(df.filter("false"), RULES)
    assert empty.count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(df.filter("rule is null") if "rule" in df.columns else df.filter("page_id = 3"), RULES).collect()} == {"allow"}


def test_url_model_learns(spark):
    rng = random.Random(4)
    make = lambda bad: (f"{'casino' if bad else 'library'}{rng.randint(0, 99)}.net", f"/{'win' if bad else 'book'}/{rng.randint(0, 999)}", "block" if bad else "allow")
    train = spark.createDataFrame([make(i % 2) for i in range(120)], "host string, path string, verdict string")
    test = spark.createDataFrame([(f"http://{h}{p}", v) for h, p, v in (make(i % 2) for i in range(60))], "url string, want string")
    got = url_filter.filter_urls(test, [], train).collect()
    assert sum(r["want"] == r["verdict"] for r in got) >= 57


def test_urls_of_any_length_are_judged_whole(spark, monkeypatch):
    rng = random.Random(5)
    part = lambda n: "".join(rng.choice("abcdefghij/-") for _ in range(n))
    paths = [part(3_000_000), part(700), "", "/a", *[part(rng.randrange(40)) for _ in range(50)]]
    hosts = ["example.org", part(100_000), *[part(9) for _ in paths[2:]]]
    weights = np.random.default_rng(1).normal(0, 3, url_filter.DIM + 1)
    df = spark.createDataFrame([(i, h, p) for i, (h, p) in enumerate(zip(hosts, paths, strict=True))], "i long, host string, path string")
    want = {r["i"]: r["p_block"] for r in url_filter.judge(df, weights).collect()}
    cells, counts = url_filter._counts(pa.array(hosts), pa.array(paths))
    for piece in (1 << 22, 1000, 37):
        monkeypatch.setattr(url_filter, "PIECE", piece)
        again = url_filter._counts(pa.array(hosts[1:]), pa.array(paths[1:]))
        keep = cells >= url_filter.DIM
        assert (again[0] == cells[keep] - url_filter.DIM).all() and (again[1] == counts[keep]).all()
    assert all(0 <= p <= 1 for p in want.values()) and len(set(want.values())) > 40
