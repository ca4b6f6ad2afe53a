import hashlib
import hmac
import zlib
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from verdictlab.functions import scalars as sc

TEXTS = ["", "a b", "x|y%z+*~", "tab\tnew\nline", "漢字 ไทย 😀", None, "\\N"]


def test_pseudonym_is_hmac(spark):
    df = spark.createDataFrame([(i,) for i in (0, 7, 2**62)], "id long")
    for salt in ("s", "k" * 100):
        for r in df.select("id", sc.pseudonym(F.col("id"), salt).alias("p")).collect():
            assert r["p"] == hmac.new(salt.encode(), f"id:{r['id']}".encode(), hashlib.sha256).hexdigest()[:16]
    assert [r[0] for r in df.select(sc.pseudonym(F.col("id"), "")).collect()] == ["0", "7", str(2**62)]


def test_salts_are_apart():
    s = sc.derive_salt("fp")
    assert s != sc.derive_salt("fp", "x") != sc.derive_salt("fpx")
    assert len(s) == 64 and len(sc.salt_check(s)) == 16 and len(sc.corpus_token("fp")) == 8
    assert sc.salt_check("") == ""


def test_percent_coding_round_trip(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").withColumn("e", sc.percent_encode(F.col("t")))
    for r in df.withColumn("b", sc.percent_decode(F.col("e"))).collect():
        assert r["b"] == r["t"]
        assert r["e"] == ("\\N" if r["t"] is None else quote(r["t"], safe=""))


def test_row_crc_skips_nulls(spark):
    df = spark.createDataFrame([("ä", None, "c")], "a string, b string, c string")
    assert df.select(sc.row_crc("a", "b", "c")).first()[0] == zlib.crc32("ä\x1fc".encode())


def test_identity_keys(spark, rows):
    df = spark.createDataFrame([(1, " IP ", "A@x.org ", ""), (2, "", "", "\tHTTP://U\n"), (3, None, None, None)], "comment_id long, author_ip string, author_email string, author_url string")
    assert rows(sc.identity_keys(df)) == [(1, "e:a@x.org"), (1, "i:ip"), (2, "i:"), (2, "u:http://u"), (3, "i:")]
    assert (2, "c:2") in rows(sc.identity_keys(df, split_empty_ip=True))
    assert [r[0] for r in df.orderBy("comment_id").select(sc.anchor("email")).collect()] == ["e:a@x.org", "c:2", "c:3"]
    with pytest.raises(ValueError):
        sc.anchor("other")


def test_labels_types_scripts(spark):
    df = spark.createDataFrame([("", None), ("pings", ""), ("comment", "css")], "t string, r string")
    got = df.select(sc.norm_type(F.col("t")), sc.reaction(F.col("t")), sc.origin_label(F.col("r"), "ham"), sc.submission(F.col("r"))).collect()
    assert [tuple(r) for r in got] == [("comment", "comment", "ham", "genuine"), ("pings", "linkback", "ham", "genuine"), ("comment", "comment", "css", "decoy")]
    s = spark.createDataFrame([("漢",), ("ไ",), ("한",), ("か",), ("é😀",), (None,)], "t string")
    assert [r[0] for r in s.select(sc.script_class(F.col("t"))).collect()] == ["spaceless"] * 4 + ["latin"] * 2


def test_version_order(spark):
    v = ["2.9.0", "v2.11.12", "3.0.0-beta.2", "3.0.0-beta.10", "3.0.0-rc.1", "releases/prepare-3.0.0", "3.0.1"]
    df = spark.createDataFrame([(x,) for x in reversed(v)], "v string").withColumn("k", sc.version_key(F.col("v")))
    assert [r[0] for r in df.orderBy("k").collect()] == v
    assert spark.createDataFrame([("none",)], "v string").select(sc.version_key(F.col("v"))).first()[0] is None


def test_rule_hits(spark, rows):
    df = spark.createDataFrame([("a", "x,y"), ("b", None)], "id string, reason string")
    assert rows(sc.rule_hits(df)) == [("a", "x"), ("a", "y"), ("b", None)]
