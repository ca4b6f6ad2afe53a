import random

import pytest

from verdictlab.operators import clusters as cl, ordered, sampling as sa
from verdictlab.operators.components import connected_components
from verdictlab.operators.offsets import with_row_number, with_running_sum
from pyspark.sql import functions as F

SCHEMA = "comment_id long, author_ip string, author_email string, author_url string"


def comments(rng, n=60):
    return [(i, f"ip{rng.randint(0, 25)}", rng.choice(["", f"e{rng.randint(0, 12)}@x"]), rng.choice(["", "", f"u{rng.randint(0, 9)}"])) for i in range(n)]


def keys_of(r):
    return [f"i:{r[1]}"] + ([f"e:{r[2]}"] if r[2] else []) + ([f"u:{r[3]}"] if r[3] else [])


def union_find(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(i, i + 1) for i in range(200, 230)] + [(300, i) for i in range(301, 330)]
    df = spark.createDataFrame([*pairs, (None, 1), (4, 4)], "a long, b long").repartition(5)
    want = union_find([p for p in pairs if p[0] != p[1]])
    assert dict(connected_components(df).collect()) == want
    assert connected_components(df.filter("false")).count() == 0


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_identity_clusters(spark, parts):
    data = comments(random.Random(parts))
    df = spark.createDataFrame(data, SCHEMA).repartition(parts)
    want = union_find([(keys_of(r)[0], k) for r in data for k in keys_of(r)])
    got = dict(cl.identity_clusters(df).collect())
    assert got == {r[0]: min(k for k in want if want[k] == want[keys_of(r)[0]]) for r in data}
    sh = cl.assign_shards(cl.identity_clusters(df), 4)
    assert sh.groupBy("cluster").agg(F.countDistinct("shard").alias("n")).filter("n > 1").count() == 0
    assert cl.skew(cl.shard_sizes(sh, 4)).first()["total"] == len(data)


def test_mode_guard(spark):
    cl.check_mode("identity", ("db-spam",))
    cl.check_mode("email")
    modes = spark.createDataFrame([("email", ["db-spam"]), ("email", ["bbcode"]), ("identity", ["db-spam"]), ("mod", [])], "m string, r array<string>")
    assert [r[0] for r in modes.select(cl.mode_fits(F.col("m"), F.col("r"))).collect()] == [False, True, True, False]
    for bad in (("email", ("db-spam",)), ("mod", ())):
        with pytest.raises(ValueError):
            cl.check_mode(*bad)


def fold(data, seeds, trust=True, repeat=True):
    spam_keys, approved, out = set(), set(), {}
    for r in data:
        ks = keys_of(r)
        trusted = trust and bool(r[2]) and f"e:{r[2]}" in approved
        again = repeat and any(k in spam_keys for k in ks)
        spam = not trusted and (r[0] in seeds or again)
        if spam:
            spam_keys.update(ks)
        elif r[2]:
            approved.add(f"e:{r[2]}")
        out[r[0]] = (trusted, again, spam)
    return out


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("block", [7, 1000])
def test_order_dependent_rules_equal_a_fold(spark, seed, block):
    rng = random.Random(seed)
    data = comments(rng, 50)
    seeds = set(rng.sample(range(50), 5))
    df = spark.createDataFrame(rng.sample(data, len(data)), SCHEMA).repartition(3)
    sd = spark.createDataFrame([(i,) for i in seeds], "comment_id long")
    want = {i for i, x in fold(data, seeds, trust=False).items() if x[2]}
    assert {r[0] for r in ordered.db_spam(df, sd, block).collect()} == want
    got = {r["comment_id"]: (r["trusted"], r["repeat"], r["spam"]) for r in ordered.ordered_rules(df, sd, block).collect()}
    assert got == fold(data, seeds)
    with_spam = df.join(sd.withColumn("s", F.lit(True)), "comment_id", "left").withColumn("s", F.coalesce("s", F.lit(False))).withColumn("author_email", F.expr("nullif(author_email, '')"))
    got = {r["comment_id"]: (r["trusted"], r["final_spam"]) for r in ordered.approved_email(with_spam, "author_email", "comment_id", "s").collect()}
    # trust from content alone: a row is approved when its content isn't spam
    first = {}
    for r in data:
        if r[2] and r[0] not in seeds:
            first.setdefault(r[2], r[0])
    assert got == {r[0]: (bool(r[2]) and first.get(r[2], 10**9) < r[0], r[0] in seeds and not (bool(r[2]) and first.get(r[2], 10**9) < r[0])) for r in data}


@pytest.mark.parametrize("block", [1200, 10_000])
def test_a_chain_of_any_length(spark, block):
    # each comment shares its address with the one before and its URL with the one after; some e-mails are known by then
    data = [(i, f"ip{i // 2}", f"e{i % 900}@x" if i % 50 == 7 else "", f"u{(i + 1) // 2}") for i in range(5000)]
    df, sd = spark.createDataFrame(data, SCHEMA).repartition(6), spark.createDataFrame([(0,), (4000,)], "comment_id long")
    assert ordered.db_spam(df, sd, block).count() == 5000
    got = {r["comment_id"]: (r["trusted"], r["repeat"], r["spam"]) for r in ordered.ordered_rules(df, sd, block).collect()}
    assert got == fold(data, {0, 4000})


def test_repeated_comments_and_seeds_that_are_not_there(spark):
    data = [(0, "a", "", ""), (1, "a", "", ""), (1, "a", "", ""), (2, None, None, None)]
    df, sd = spark.createDataFrame(data, SCHEMA), spark.createDataFrame([(0,), (0,), (77,)], "comment_id long")
    assert sorted(tuple(r) for r in ordered.db_spam(df, sd).collect()) == [(0, True), (1, False), (77, True)]
    assert sorted((r["comment_id"], r["spam"]) for r in ordered.ordered_rules(df, sd).collect()) == [(0, True), (1, True), (2, False)]
    assert ordered.ordered_rules(df.limit(0), sd).count() == 0


def test_no_seeds(spark):
    df = spark.createDataFrame(comments(random.Random(0), 5), SCHEMA)
    assert ordered.db_spam(df, spark.createDataFrame([], "comment_id long")).count() == 0


def test_stride_equals_the_formula(spark):
    sizes = {"a": 1, "b": 7, "c": 8, "d": 23, "e": 50, "f": 51}
    rows = [(i * 10 + ord(k), k) for k, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "comment_id long, k string").repartition(7)
    got = {}
    for r in sa.stratified_sample(df, 7, F.col("k") != "f", ["k"]).collect():
        got.setdefault(r["k"], []).append(r["comment_id"])
    for k, n in sizes.items():
        ids = sorted(x for x, y in rows if y == k)
        want = ids if n <= 7 or k == "f" else [ids[p] for p in sorted({int(i * (n / 7)) for i in range(7)})]
        assert sorted(got[k]) == want, k


def test_row_numbers_and_running_sums(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") * 7 % 13).alias("v")).repartition(9)
    got = {r["id"]: r["n"] for r in with_row_number(df, [F.desc("id")]).collect()}
    assert got == {i: 100 - i for i in range(100)}
    run = {r["id"]: r["running"] for r in with_running_sum(df, [F.asc("id")], "v").collect()}
    assert run == {i: sum(j * 7 % 13 for j in range(i + 1)) for i in range(100)}
    assert with_row_number(df.filter("false"), [F.asc("id")]).count() == 0


def test_small_samples(spark, rows):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b", "t") for i in range(9)], "comment_id long, reason string, type string")
    assert [r[0] for r in rows(sa.top_n_per_group(df, ["reason"], 2))] == [0, 1, 2, 3]
    assert rows(sa.type_counts(df)) == [("a", 6, "t x6"), ("b", 3, "t x3")]
    assert [r[0] for r in rows(sa.systematic_sample(df, 4))] == [0, 4, 8]
