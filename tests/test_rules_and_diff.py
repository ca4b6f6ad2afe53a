import random
import re

import pytest
from pyspark.sql import functions as F

from verdictlab.functions import rules
from verdictlab.operators import diff as d, gates, joins

V = "id string, status string, reason string"


def test_front_door_and_order(spark, rows):
    c = spark.createDataFrame([(1, "mail a@b.cd or 1.2.3.4", "", "x"), (2, "", "", "x"), (3, "123 456", "pingback", "Blog"), (4, None, "", ""), (5, "ok [url=x]", "trackback", "x")], "comment_id long, content string, type string, author string")
    rs = rules.Ruleset((*rules.new_rules().rules, rules.bbcode(), rules.title_is_name("Blog")))
    assert rows(rules.classify(c, rs)) == [("1", "spam", "r-email,r-ip"), ("3", "spam", "r-phone,title_is_name"), ("5", "1", None)]
    assert rows(rules.classify(c, rs.without("r-email")))[0] == ("1", "spam", "r-ip")
    final = rules.Ruleset((rules.Rule("first", lambda: F.col("author") == "x", final=True), *rs.rules))
    assert rows(rules.classify(c, final))[0] == ("1", "spam", "first")
    assert rows(rules.classify(c, rules.Ruleset())) == [("1", "1", None), ("3", "1", None), ("5", "1", None)]
    assert rows(rules.classify(c, rules.Ruleset().add("own", "length(content) > 8")))[0] == ("1", "spam", "own")


def test_options_scope_rules(spark, rows):
    c = spark.createDataFrame([(1, "a@b.cd", ""), (2, "a@b.cd", "pingback")], "comment_id long, content string, type string")
    rs = rules.old_rules().from_options('{"linkback": {"r-email": "on"}}')
    assert rows(rules.classify(c, rs)) == [("1", "1", None), ("2", "spam", "r-email")]
    assert rules.old_rules().from_options({}).rules == ()


def test_language_rule_and_detector(spark, rows):
    c = spark.createDataFrame([(1, "short", "", "xx"), (2, "a long enough text", "", "xx"), (3, "the cat of the house and the dog", "", "en")], "comment_id long, content string, type string, lang string")
    assert [r[1] for r in rows(rules.classify(c, rules.Ruleset((rules.language(["en"]),))))] == ["1", "spam", "1"]
    got = dict(c.select("comment_id", rules.detect_language(F.col("content"))).collect())
    assert got == {1: "und", 2: "en", 3: "en"}


def sides(spark):
    old = [("1", "spam", "a"), ("2", "1", None), ("3", "spam", "a"), ("4", "1", ""), ("5", "0", None), ("6", "spam", None), ("old", "1", None)]
    new = [("1", "spam", "a,b"), ("2", "spam", "b"), ("3", "spam", "a"), ("4", "1", None), ("5", "1", None), ("6", "0", None), ("new", "spam", "c")]
    return spark.createDataFrame(old, V), spark.createDataFrame(new, V)


def test_flip_comes_before_reason(spark, rows):
    x = joins.diff(*sides(spark))
    assert [r[0] for r in rows(d.flips(x))] == ["2", "6"]  # 6: both reasons null
    assert [r[0] for r in rows(d.reason_diffs(x))] == ["1", "4"]  # empty and null differ
    s = d.summary(x).first().asDict()
    assert s == {"old_total": 7, "new_total": 7, "compared": 6, "only_in_old": 1, "only_in_new": 1, "spam_flips": 2, "reason_diffs": 2, "flip_percent": 33.3333}
    assert rows(d.reason_transitions(x)) == [("", "(none)", 1), ("a", "a,b", 1)]
    assert rows(d.gains(x)) == [("b", 1)]
    assert d.more_flips(d.flips(x), 1).first()[0] == 1 and d.list_flips(d.flips(x), None).count() == 2


def test_origins(spark, rows):
    f = d.flips(joins.diff(*sides(spark)))
    o = spark.createDataFrame([(2, ""), (9, "css")], "comment_id long, reason string")
    got = joins.label_flips(f, o)
    assert {r["id"]: r["origin"] for r in got.collect()} == {"2": "unflagged", "6": None}
    assert rows(d.flip_origins(got)) == [("unflagged", "=> spam", 1)]


def test_empty_intersection_and_overlap(spark):
    a = spark.createDataFrame([(str(i), "1", None) for i in range(100)], V)
    b = spark.createDataFrame([(str(i), "1", None) for i in range(1, 101)], V)
    c = spark.createDataFrame([(str(i), "1", None) for i in range(2, 102)], V)
    gates.assert_comparable(d.summary(joins.diff(a, b)))  # 99 of 100
    with pytest.raises(gates.GateError):
        gates.assert_comparable(d.summary(joins.diff(a, c)))
    none = spark.createDataFrame([], V)
    s = d.summary(joins.diff(none, none))
    assert s.first()["flip_percent"] == 0.0
    with pytest.raises(gates.GateError):
        gates.assert_comparable(s)
    with pytest.raises(gates.GateError, match="salt"):
        gates.assert_comparable(d.summary(joins.diff(a, b)), {"salt_check": "x"}, {"salt_check": "y"})
    gates.assert_comparable(d.summary(joins.diff(a, b)), {"salt_check": "x"}, None)


def test_gates(spark):
    x = d.summary(joins.diff(*sides(spark)))
    assert gates.gate(x, fail=False) == 2
    with pytest.raises(gates.GateError):
        gates.gate(x)
    two = spark.createDataFrame([("a",), ("a",)], "pid string")
    with pytest.raises(gates.GateError):
        gates.assert_unique(two, "pid")
    with pytest.raises(gates.GateError):
        gates.assert_nonempty(two.filter("false"))
    assert gates.publishable({"salt_check": "x", "shard_mode": "email"}) and not gates.publishable({"salt_check": "x", "shard_mode": "cluster"})


def test_two_meta_rows_take_the_lowest(spark, rows):
    m = spark.createDataFrame([(5, 1, "reason", "late"), (2, 1, "reason", "first"), (1, 1, "note", "n")], "meta_id long, comment_id long, meta_key string, meta_value string")
    c = spark.createDataFrame([(1,), (2,)], "comment_id long")
    assert rows(joins.with_meta(c, m, "reason", "r")) == [(1, "first"), (2, None)]


def test_baseline_choice(spark):
    tags = ["2.11.12", "v2.9.0", "3.0.0-beta.2", "3.0.0-beta.10", "3.0.0-rc.1", "3.0.0"]
    ask = ["3.0.0-rc.2", "3.0.0-beta.10", "3.1.0-beta.1", "3.0.0", "2.10.0", "1.0.0", "3.0.1"]
    t, p = (spark.createDataFrame([(x,) for x in xs], "version string") for xs in (tags, ask))
    got = {r["version"]: r["baseline"] for r in joins.baseline_for(p, t).collect()}
    assert got == {"3.0.0-rc.2": "3.0.0-rc.1", "3.0.0-beta.10": "3.0.0-beta.2", "3.1.0-beta.1": "3.0.0", "3.0.0": "2.11.12", "2.10.0": "v2.9.0", "1.0.0": None, "3.0.1": "3.0.0"}


@pytest.mark.parametrize("parts", [1, 13])
def test_baselines_over_many_ranges(spark, parts):
    rng = random.Random(parts)
    names = [f"{rng.randint(0, 3)}.{rng.randint(0, 9)}.{rng.randint(0, 2)}" + rng.choice(["", "", f"-rc.{rng.randint(1, 9)}", f"-beta.{rng.randint(1, 9)}"]) for _ in range(300)]
    tags = sorted(set(rng.sample(names, 120)))
    versions = sorted(set(names))
    p, t = (spark.createDataFrame([(v,) for v in x], "version string").repartition(7) for x in (versions, tags))
    got = {r["version"]: r["baseline"] for r in joins.baseline_for(p, t, parts).collect()}

    def key(v):
        core, _, rest = v.partition("-")
        kind, _, n = rest.partition(".")
        return (*map(int, core.split(".")), not rest, kind, int(n or 0))

    def want(v):
        k = key(v)
        stable = max((x for x in tags if key(x)[3] and key(x) < k), key=key, default=None)
        pre = max((x for x in tags if not key(x)[3] and key(x)[:3] == k[:3] and key(x) < k), key=key, default=None)
        return stable if k[3] else pre or stable

    assert got == {v: want(v) for v in versions}


def test_languages_split_a_text_once_and_count_whole_words(spark):
    texts = [None, "", "  the  ", "THE\tof\ncan", "der the", "the,", "für FÜR más", "\x00the the", "a the the\x0bthe", "the\x85", "la la le y", "le\r\nles con con"]
    want = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        n = {code: sum(w in own.split() for w in words) for code, own in sorted(rules.STOP_WORDS.items())}
        best = max(n, key=n.get)
        want.append(best if n[best] else "und")
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", rules.detect_language(F.col("t")).alias("found"))
    assert [r["found"] for r in df.orderBy("id").collect()] == want
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1
