"""Corpus, meta, verdict and catalogue views over the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from verdictlab.functions import rules
from verdictlab.functions.rules import DOTTED_QUAD, EMAIL, PHONE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return corpus_of(table(spark, d, "documents"))


def corpus_of(docs: DataFrame) -> DataFrame:
    """The corpus view of a documents table, or of a stream of one."""
    n, b = F.col("doc_id"), F.expr("doc_id div 16")
    text = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in c])
    url = F.when((n % 16 == 0) & (b % 3 != 2), text("http://l", b)).when((n % 16 == 1) & (b % 3 != 0), text("http://l", b - 1)).otherwise("")
    kind = F.when(n % 10 == 0, "trackback").when(n % 10 == 1, "pingback").when(n % 10 == 2, "").otherwise("comment")
    return docs.select(
        n.alias("comment_id"), F.when(n % 37 == 0, "").otherwise(F.col("text")).alias("content"), F.col("source").alias("author"),
        text("User", b * 4 + F.expr("doc_id div 4") % 4, "@example.com ").alias("author_email"), url.alias("author_url"),
        text("ip", b * 4 + n % 4).alias("author_ip"), F.lit("").alias("agent"), kind.alias("type"), "lang",
    )


def reasons(spark: SparkSession, d: str) -> DataFrame:
    """``(comment_id, reason)``: the historical label, null for most."""
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels")
    r = F.when(F.col("doc_id") % 20 == 5, "css").when(F.col("toxic") == 1, "manually").when(F.col("quality") == 0, "regexp")
    return docs.join(labels, "doc_id", "left").select(F.col("doc_id").alias("comment_id"), r.alias("reason"))


def meta(spark: SparkSession, d: str) -> DataFrame:
    """Entity-attribute-value rows: the historical reason, and a note for every third comment."""
    r = reasons(spark, d)
    some = r.filter("reason is not null").select((F.col("comment_id") * 2).alias("meta_id"), "comment_id", F.lit("reason").alias("meta_key"), F.col("reason").alias("meta_value"))
    note = r.filter("comment_id % 3 = 0").select((F.col("comment_id") * 2 + 1).alias("meta_id"), "comment_id", F.lit("note").alias("meta_key"), F.lit("x").alias("meta_value"))
    return some.unionByName(note)


def verdicts_old(spark: SparkSession, d: str) -> DataFrame:
    return rules.classify(corpus(spark, d), rules.old_rules())


def verdicts_new(spark: SparkSession, d: str) -> DataFrame:
    return rules.classify(corpus(spark, d), rules.new_rules())


def big_old(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.expr("l_returnflag = 'R'")).alias("s"), F.min("l_linestatus").alias("m"), F.sum("l_quantity").alias("q"))
    return g.select(F.col("l_orderkey").cast("string").alias("id"), F.when(F.col("s"), "spam").otherwise("1").alias("status"), F.when(F.col("q") >= 20, F.concat(F.lit("mode-"), "m")).alias("reason"))


def big_new(spark: SparkSession, d: str) -> DataFrame:
    s = F.bool_or(F.expr("l_returnflag = 'R' and l_discount < 0.09 or l_returnflag = 'A' and l_tax > 0.07"))
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(s.alias("s"), F.min("l_linestatus").alias("m"), F.sum("l_quantity").alias("q"), F.max("l_tax").alias("t"))
    r = F.when(F.col("q") >= 20, F.concat(F.lit("mode-"), F.col("m"), F.when(F.col("t") > 0.05, ",tax").otherwise("")))
    return g.select(F.col("l_orderkey").cast("string").alias("id"), F.when(F.col("s"), "spam").otherwise("1").alias("status"), r.alias("reason"))


def replay(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Comments of a replay, with new ids, and their meta: the original id and the rules that matched."""
    v = verdicts_new(spark, d).withColumn("n", F.col("id").cast("long"))
    comments = v.select((F.col("n") + 10_000_000).alias("comment_id"), "status")
    own = v.select((F.col("n") * 2).alias("meta_id"), (F.col("n") + 10_000_000).alias("comment_id"), F.lit("original_id").alias("meta_key"), F.col("id").alias("meta_value"))
    why = v.filter("reason is not null").select((F.col("n") * 2 + 1).alias("meta_id"), (F.col("n") + 10_000_000).alias("comment_id"), F.lit("reason").alias("meta_key"), F.col("reason").alias("meta_value"))
    return comments, own.unionByName(why)


def versions(spark: SparkSession, d: str) -> DataFrame:
    """``(version)``: release tags made from the part table; every fourth is a prerelease."""
    p = F.col("p_partkey")
    core = F.concat_ws(".", (p % 4).cast("string"), (p % 7).cast("string"), (p % 11).cast("string"))
    pre = F.when(p % 4 == 0, F.concat(F.lit("-beta."), (p % 13).cast("string"))).when(p % 4 == 1, F.concat(F.lit("-rc."), (p % 3).cast("string"))).otherwise("")
    return table(spark, d, "part").select(F.concat(F.when(p % 2 == 0, "v").otherwise(""), core, pre).alias("version")).distinct()


def catalog(spark: SparkSession, d: str) -> DataFrame:
    """Snapshot manifests made from the orders: path, conditions, and when they were made."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select(
        F.concat(F.lit("snap-"), F.lpad(k.cast("string"), 9, "0")).alias("path"), F.when(k % 50 == 0, 1).otherwise(2).alias("schema"),
        k.alias("rows"), F.concat(F.lit("commit"), (k % 40).cast("string")).alias("commit_sha"), F.concat(F.lit("corpus"), (c % 5).cast("string")).alias("corpus_token"),
        F.when(k % 3 == 0, "identity").when(k % 3 == 1, "email").otherwise("mod").alias("shard_mode"),
        F.when(k % 4 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("opt"), (k % 3).cast("string"))).alias("options_fp"),
        F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("check"), (c % 2).cast("string"))).alias("salt_check"),
        F.when(k % 9 == 0, F.lit(None).cast("string")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("created_at"),
        F.create_map(F.lit("workers"), (k % 6).cast("string"), F.lit("minor"), F.concat(F.lit("8."), (k % 3).cast("string"))).alias("soft"),
    )


#: The same views in SQL; queries put them in front.
SQL = rf"""
corpus AS (SELECT doc_id AS comment_id, CASE WHEN doc_id % 37 = 0 THEN '' ELSE text END AS content, source AS author,
  'User' || (doc_id // 16 * 4 + (doc_id // 4) % 4) || '@example.com ' AS author_email,
  CASE WHEN doc_id % 16 = 0 AND (doc_id // 16) % 3 <> 2 THEN 'http://l' || (doc_id // 16)
       WHEN doc_id % 16 = 1 AND (doc_id // 16) % 3 <> 0 THEN 'http://l' || (doc_id // 16 - 1) ELSE '' END AS author_url,
  'ip' || (doc_id // 16 * 4 + doc_id % 4) AS author_ip, '' AS agent,
  CASE WHEN doc_id % 10 = 0 THEN 'trackback' WHEN doc_id % 10 = 1 THEN 'pingback' WHEN doc_id % 10 = 2 THEN '' ELSE 'comment' END AS type, lang
  FROM documents),
reasons AS (SELECT d.doc_id AS comment_id, CASE WHEN d.doc_id % 20 = 5 THEN 'css' WHEN toxic = 1 THEN 'manually' WHEN quality = 0 THEN 'regexp' END AS reason
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
meta AS (SELECT comment_id * 2 AS meta_id, comment_id, 'reason' AS meta_key, reason AS meta_value FROM reasons WHERE reason IS NOT NULL
  UNION ALL SELECT comment_id * 2 + 1, comment_id, 'note', 'x' FROM reasons WHERE comment_id % 3 = 0),
hits AS (SELECT comment_id, regexp_matches(content, '{EMAIL}') AS e, regexp_matches(content, '{DOTTED_QUAD}') AS q, regexp_matches(content, '{PHONE}') AS p
  FROM corpus WHERE content <> ''),
verdicts_old AS (SELECT CAST(comment_id AS VARCHAR) AS id, CASE WHEN e THEN 'spam' ELSE '1' END AS status, CASE WHEN e THEN 'r-email' END AS reason FROM hits),
verdicts_new AS (SELECT CAST(comment_id AS VARCHAR) AS id, CASE WHEN e OR q OR p THEN 'spam' ELSE '1' END AS status,
  nullif(concat_ws(',', CASE WHEN e THEN 'r-email' END, CASE WHEN q THEN 'r-ip' END, CASE WHEN p THEN 'r-phone' END), '') AS reason FROM hits),
big_old AS (SELECT CAST(l_orderkey AS VARCHAR) AS id, CASE WHEN bool_or(l_returnflag = 'R') THEN 'spam' ELSE '1' END AS status,
  CASE WHEN sum(l_quantity) >= 20 THEN 'mode-' || min(l_linestatus) END AS reason FROM lineitem GROUP BY l_orderkey),
big_new AS (SELECT CAST(l_orderkey AS VARCHAR) AS id,
  CASE WHEN bool_or(l_returnflag = 'R' AND l_discount < 0.09 OR l_returnflag = 'A' AND l_tax > 0.07) THEN 'spam' ELSE '1' END AS status,
  CASE WHEN sum(l_quantity) >= 20 THEN 'mode-' || min(l_linestatus) || CASE WHEN max(l_tax) > 0.05 THEN ',tax' ELSE '' END END AS reason
  FROM lineitem GROUP BY l_orderkey),
versions AS (SELECT DISTINCT (CASE WHEN p_partkey % 2 = 0 THEN 'v' ELSE '' END) || (p_partkey % 4) || '.' || (p_partkey % 7) || '.' || (p_partkey % 11) ||
  CASE WHEN p_partkey % 4 = 0 THEN '-beta.' || (p_partkey % 13) WHEN p_partkey % 4 = 1 THEN '-rc.' || (p_partkey % 3) ELSE '' END AS version FROM part),
catalog AS (SELECT 'snap-' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS path, CASE WHEN o_orderkey % 50 = 0 THEN 1 ELSE 2 END AS schema, o_orderkey AS rows,
  'commit' || (o_orderkey % 40) AS commit_sha, 'corpus' || (o_custkey % 5) AS corpus_token,
  CASE WHEN o_orderkey % 3 = 0 THEN 'identity' WHEN o_orderkey % 3 = 1 THEN 'email' ELSE 'mod' END AS shard_mode,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'opt' || (o_orderkey % 3) END AS options_fp,
  CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'check' || (o_custkey % 2) END AS salt_check,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END AS created_at,
  CAST(o_orderkey % 6 AS VARCHAR) AS soft_workers, '8.' || (o_orderkey % 3) AS soft_minor FROM orders)
"""


def sql(body: str, *more: str, recursive: bool = False) -> str:
    """``body`` with the views that it names (and those that they name) in front."""
    parts = {p.split(" AS ", 1)[0].strip(): p for p in _parts()}
    need: list[str] = []

    def add(text: str) -> None:
        for name, p in parts.items():
            if name not in need and name in text.replace("(", " ").replace(")", " ").replace(",", " ").split():
                add(p.split(" AS ", 1)[1])
                need.append(name)

    add(" ".join((body, *more)))
    front = [parts[n].strip() for n in parts if n in need] + [m.strip() for m in more]
    return (("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(front) + "\n" if front else "") + body


def _parts() -> list[str]:
    out, depth, own = [], 0, ""
    for ch in SQL:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(own)
            own = ""
        else:
            own += ch
    return [*out, own]
