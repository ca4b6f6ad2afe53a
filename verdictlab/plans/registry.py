"""The registered queries and their SQL, by name. A query without SQL is tested by brute force or by its properties."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from verdictlab.functions import rules, scalars as sc
from verdictlab.functions.shared import materialise, shared_dir
from verdictlab.operators import aggregates as ag, clusters as cl, diff as df_, gates, joins, ordered, sampling as sa
from verdictlab.plans import views
from verdictlab.plans.views import sql, table
from verdictlab.streaming import incremental as inc
from verdictlab.sources import catalog as cat, corpus as src, passes, snapshot as snap

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SALT = "pepper"


def query(name: str, text: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if text is not None:
            ORACLE[name] = text
        return fn

    return put


def _folder(spark: SparkSession) -> str:
    import uuid

    return f"{shared_dir(spark)}/verdictlab/{uuid.uuid4().hex}"


def _diff(s: SparkSession, d: str) -> DataFrame:
    return joins.diff(views.verdicts_old(s, d), views.verdicts_new(s, d))


def _big(s: SparkSession, d: str) -> DataFrame:
    return joins.diff(views.big_old(s, d), views.big_new(s, d))


ID = "CAST(comment_id AS VARCHAR)"
BOTH = "SELECT o.id, o.status AS old_status, o.reason AS old_reason, n.status AS new_status, n.reason AS new_reason FROM {old} o JOIN {new} n ON o.id = n.id"
FLIPPED = "(old_status = 'spam') <> (new_status = 'spam')"
CHANGED = "(old_status = 'spam') = (new_status = 'spam') AND old_reason IS DISTINCT FROM new_reason"
J = "j AS (" + BOTH.format(old="verdicts_old", new="verdicts_new") + ")"
JB = "j AS (" + BOTH.format(old="big_old", new="big_new") + ")"
HMAC = "substr(sha256(unhex('{o}') || unhex(sha256(unhex('{i}') || encode('id:' || {c})))), 1, 16)"


def pid_sql(column: str) -> str:
    i, o = sc._pads(SALT.encode())
    return HMAC.format(i=i, o=o, c=column)


# --- scans, sources, sinks -------------------------------------------------------------------------------------------

CORPUS8 = "SELECT comment_id, content, author, author_email, author_url, author_ip, agent, type FROM corpus"


@query("s1_read_corpus", sql(CORPUS8))
def s1(s, d):
    path = _folder(s)
    views.corpus(s, d).write.parquet(path)
    return src.read_corpus(s, path)


@query("s2_read_meta", sql("SELECT comment_id, meta_value AS value FROM meta WHERE meta_key = 'reason'"))
def s2(s, d):
    return src.read_meta(views.meta(s, d), "reason")


@query("s3_load_verdicts", sql("SELECT * FROM verdicts_new"))
def s3(s, d):
    return joins.load_verdicts(*views.replay(s, d))


@query("s4_load_side", sql("SELECT * FROM verdicts_new"))
def s4(s, d):
    return src.load_side(s, views.replay(s, d))[0]


@query("s5_export_snapshot", sql(f"SELECT {pid_sql('id')} AS id, status, reason FROM verdicts_new"))
def s5(s, d):
    path = _folder(s)
    snap.export_snapshot(views.verdicts_new(s, d), SALT, {"shard_mode": "identity"}, path)
    return snap.read_snapshot(s, path)[1]


@query("s6_write_text_snapshot", sql("SELECT * FROM big_new"))
def s6(s, d):
    path = _folder(s)
    snap.write_text(views.big_new(s, d), path, {"ref": "head"})
    return snap.read_text(s, path)[1]


@query("s7_read_snapshot", sql("SELECT * FROM big_new"))
def s7(s, d):
    path = _folder(s)
    snap.write_snapshot(views.big_new(s, d), path, {})
    return snap.read_snapshot(s, path)[1]


@query("s8_read_manifest", sql("SELECT 2 AS schema, count(*) AS rows, true AS publishable, 'head' AS ref FROM big_old"))
def s8(s, d):
    path = _folder(s)
    snap.write_snapshot(views.big_old(s, d), path, {"ref": "head", "salt_check": "x", "shard_mode": "email"})
    return snap.read_manifest(s, path).select("schema", "rows", "publishable", "ref")


@query("s9_save_labelled", sql("SELECT *, 'old' AS label FROM verdicts_new UNION ALL SELECT *, 'new' FROM verdicts_new"))
def s9(s, d):
    path = _folder(s)
    src.save_labelled(views.verdicts_old(s, d), path, "old")
    src.save_labelled(views.verdicts_new(s, d), path, "new")
    src.save_labelled(views.verdicts_new(s, d), path, "old")
    return s.read.parquet(path)


PASSES = "passes AS (SELECT 'label' || (o_custkey % 50) AS label, 'sha' || o_orderkey AS git_sha, CAST(o_orderkey % 7 AS INTEGER) AS comment_count, o_orderdate AS created_at FROM orders)"


def _passes(s, d):
    o = table(s, d, "orders")
    return o.select(F.concat(F.lit("label"), F.col("o_custkey") % 50).alias("label"), F.concat(F.lit("sha"), "o_orderkey").alias("git_sha"), (F.col("o_orderkey") % 7).cast("int").alias("comment_count"), F.col("o_orderdate").alias("created_at"))


LATEST = "SELECT label, git_sha, comment_count, created_at FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY created_at DESC, git_sha DESC) AS k FROM passes) WHERE k = 1"


@query("s10_register_pass", sql(LATEST, PASSES))
def s10(s, d):
    p = _passes(s, d)
    return src.register_pass(p.filter("comment_count < 4"), p.filter("comment_count >= 4"))


@query("s10_upsert_passes", sql(LATEST, PASSES))
def s10_upsert(s, d):
    p, path = _passes(s, d).withColumn("created_at", F.col("created_at").cast("timestamp_ntz")), _folder(s)
    for k in (2, 0, 1):
        passes.upsert_passes(s, path, p.filter(F.col("comment_count") % 3 == k))
    return passes.read_passes(s, path).withColumn("created_at", F.col("created_at").cast(_passes(s, d).schema["created_at"].dataType))


@query("s11_write_shards", sql("SELECT comment_id, CASE WHEN e = '' THEN 'c:' || comment_id ELSE 'e:' || e END AS cluster FROM (SELECT comment_id, lower(trim(author_email)) AS e FROM corpus)"))
def s11(s, d):
    path = _folder(s)
    src.write_shards(cl.assign_shards(cl.email_clusters(views.corpus(s, d)), 8), path)
    return s.read.parquet(path).select("comment_id", "cluster")


@query("s12_write_reduced", sql("SELECT c.comment_id, c.content, m.meta_value FROM corpus c LEFT JOIN meta m ON m.comment_id = c.comment_id AND m.meta_key = 'reason' WHERE c.comment_id % 10 = 0"))
def s12(s, d):
    path, c = _folder(s), views.corpus(s, d)
    src.write_reduced(c, views.meta(s, d), sa.systematic_sample(c, 10), path)
    m = s.read.parquet(f"{path}/meta").filter("meta_key = 'reason'").select("comment_id", "meta_value")
    return s.read.parquet(f"{path}/corpus").join(m, "comment_id", "left").select("comment_id", "content", "meta_value")


def _sample(s, d):
    c = views.corpus(s, d).join(views.reasons(s, d), "comment_id")
    return c.withColumn("is_ham", F.col("reason").isNull())


SAMPLE = "sample AS (SELECT c.*, r.reason, r.reason IS NULL AS is_ham FROM corpus c JOIN reasons r ON c.comment_id = r.comment_id)"


@query("s13_sample_tsv", sql("SELECT comment_id, is_ham, type, coalesce(reason, '') AS reason, content, author_url, agent FROM sample", SAMPLE))
def s13(s, d):
    path = _folder(s)
    src.write_sample_tsv(_sample(s, d), path)
    return src.read_sample_tsv(s, path)


TOTALS = """totals AS (SELECT count(o.id) AS old_total, count(n.id) AS new_total, count(*) FILTER (WHERE o.id IS NOT NULL AND n.id IS NOT NULL) AS compared,
  count(*) FILTER (WHERE n.id IS NULL) AS only_in_old, count(*) FILTER (WHERE o.id IS NULL) AS only_in_new,
  count(*) FILTER (WHERE o.id IS NOT NULL AND n.id IS NOT NULL AND (o.status = 'spam') <> (n.status = 'spam')) AS spam_flips,
  count(*) FILTER (WHERE o.id IS NOT NULL AND n.id IS NOT NULL AND (o.status = 'spam') = (n.status = 'spam') AND o.reason IS DISTINCT FROM n.reason) AS reason_diffs
  FROM {a} o FULL JOIN {b} n ON o.id = n.id)"""
SUMMARY = "SELECT *, round(CASE WHEN compared > 0 THEN spam_flips * 100.0 / compared ELSE 0 END, 4) AS flip_percent FROM totals"


@query("s14_stats_json", sql("SELECT '{\"counts\":{\"old_total\":' || old_total || ',\"new_total\":' || new_total || ',\"compared\":' || compared || ',\"only_in_old\":' || only_in_old || ',\"only_in_new\":' || only_in_new || ',\"spam_flips\":' || spam_flips || ',\"reason_diffs\":' || reason_diffs || '}}' AS json FROM totals", TOTALS.format(a="big_old", b="big_new")))
def s14(s, d):
    j = df_.stats_json(_big(s, d)).select(F.from_json("json", "counts struct<old_total: long, new_total: long, compared: long, only_in_old: long, only_in_new: long, spam_flips: long, reason_diffs: long>").alias("j"))
    return j.select(F.to_json("j").alias("json"))


@query("s14_stats_with_origins", sql("SELECT '{\"counts\":{\"old_total\":' || old_total || ',\"new_total\":' || new_total || ',\"compared\":' || compared || ',\"only_in_old\":' || only_in_old || ',\"only_in_new\":' || only_in_new || ',\"spam_flips\":' || spam_flips || ',\"reason_diffs\":' || reason_diffs || '},\"flip_origins\":[' || coalesce((SELECT string_agg('{\"origin\":\"' || origin || '\",\"direction\":\"' || direction || '\",\"n\":' || n || '}', ',' ORDER BY origin, direction) FROM o), '') || ']}' AS json FROM totals",
    TOTALS.format(a="verdicts_old", b="verdicts_new"), J, f"o AS (SELECT coalesce(r.reason, 'unflagged') AS origin, CASE WHEN new_status = 'spam' THEN '=> spam' ELSE '=> not spam' END AS direction, count(*) AS n FROM j JOIN reasons r ON CAST(r.comment_id AS VARCHAR) = j.id WHERE {FLIPPED} GROUP BY ALL)"))
def s14_origins(s, d):
    j = df_.stats_json(_diff(s, d), joins.label_flips(df_.flips(_diff(s, d)), views.reasons(s, d)))
    kind = "counts struct<old_total: long, new_total: long, compared: long, only_in_old: long, only_in_new: long, spam_flips: long, reason_diffs: long>, flip_origins array<struct<origin: string, direction: string, n: long>>"
    return j.select(F.to_json(F.from_json("json", kind)).alias("json"))


# --- scalar functions ------------------------------------------------------------------------------------------------

KEYS = """keys AS (SELECT comment_id, 'i:' || lower(trim(author_ip)) AS key FROM corpus
  UNION ALL SELECT comment_id, 'e:' || lower(trim(author_email)) FROM corpus WHERE trim(author_email) <> ''
  UNION ALL SELECT comment_id, 'u:' || lower(trim(author_url)) FROM corpus WHERE trim(author_url) <> '')"""


@query("p1_identity_keys", sql("SELECT * FROM keys", KEYS))
def p1(s, d):
    return sc.identity_keys(views.corpus(s, d))


@query("p2_anchor", sql("SELECT comment_id, 'i:' || lower(trim(author_ip)) AS identity, CASE WHEN trim(author_email) = '' THEN 'c:' || comment_id ELSE 'e:' || lower(trim(author_email)) END AS email FROM corpus"))
def p2(s, d):
    return views.corpus(s, d).select("comment_id", sc.anchor("identity").alias("identity"), sc.anchor("email").alias("email"))


@query("p3_norm_type", sql("SELECT comment_id, CASE WHEN type = '' THEN 'comment' ELSE type END AS type FROM corpus"))
def p3(s, d):
    return views.corpus(s, d).select("comment_id", sc.norm_type(F.col("type")).alias("type"))


@query("p4_origin_label", sql("SELECT comment_id, coalesce(nullif(reason, ''), 'unflagged') AS label, coalesce(nullif(reason, ''), 'ham') AS stratum FROM reasons"))
def p4(s, d):
    return views.reasons(s, d).select("comment_id", sc.origin_label(F.col("reason"), "unflagged").alias("label"), sc.origin_label(F.col("reason"), "ham").alias("stratum"))


SPACELESS = r"[\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}\x{0E00}-\x{0E7F}\x{0E80}-\x{0EFF}\x{1780}-\x{17FF}\x{1000}-\x{109F}\x{0F00}-\x{0FFF}]"
P5_TEXT = "content || CASE WHEN comment_id % 5 = 0 THEN '漢字' WHEN comment_id % 5 = 1 THEN 'ไทย' WHEN comment_id % 5 = 2 THEN 'é' ELSE '' END"


@query("p5_script_class", sql(f"SELECT comment_id, CASE WHEN regexp_matches({P5_TEXT}, '{SPACELESS}') THEN 'spaceless' ELSE 'latin' END AS script FROM corpus"))
def p5(s, d):
    more = F.when(F.col("comment_id") % 5 == 0, "漢字").when(F.col("comment_id") % 5 == 1, "ไทย").when(F.col("comment_id") % 5 == 2, "é").otherwise("")
    return views.corpus(s, d).select("comment_id", sc.script_class(F.concat("content", more)).alias("script"))


@query("p6_is_spam", sql("SELECT id, coalesce(status = 'spam', false) AS spam FROM big_new"))
def p6(s, d):
    return views.big_new(s, d).select("id", sc.is_spam(F.col("status")).alias("spam"))


@query("p7_default_agent", sql("SELECT comment_id, coalesce(nullif(agent, ''), 'Mozilla/5.0 (compatible)') AS agent FROM corpus"))
def p7(s, d):
    return views.corpus(s, d).select("comment_id", sc.default_agent(F.col("agent")).alias("agent"))


@query("p8_pseudonym", f"SELECT l_orderkey AS id, {pid_sql('l_orderkey')} AS pid FROM lineitem")
def p8(s, d):
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), sc.pseudonym(F.col("l_orderkey"), SALT).alias("pid"))


P9_I, P9_O = sc._pads(b"corpus-key")


@query("p9_derive_tokens", f"SELECT c_custkey AS corpus, substr(sha256(unhex('{P9_O}') || unhex(sha256(unhex('{P9_I}') || encode('token:' || c_custkey)))), 1, 8) AS token FROM customer")
def p9(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("corpus"), F.substring(sc.hmac_sha256(F.concat(F.lit("token:"), "c_custkey"), b"corpus-key"), 1, 8).alias("token"))


#: CRC-32 of a text's UTF-8 bytes, a byte at a time with a table of 256 remainders that SQL makes first.
CRC_ROW = "concat_ws(chr(31), comment_id, content, author, author_email, author_url, author_ip, agent, type)"
CRC32_BYTES = (
    "(SELECT xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(h) // 2 + 1), lambda i: CAST(('0x' || substr(h, CAST(2 * i - 1 AS INTEGER), 2)) AS BIGINT))),"
    " lambda c, b: xor(c >> 8, t.r[(xor(c, b) & 255) + 1]))) FROM (SELECT hex(encode({0})) AS h), crc_table t)"
)
CRC_TABLE = "crc_table AS (SELECT list(list_reduce(list_prepend(n, range(CAST(8 AS BIGINT))), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY n) AS r FROM range(CAST(256 AS BIGINT)) AS q(n))"


@query("p10_row_crc", sql(f"SELECT comment_id, {CRC32_BYTES.format(CRC_ROW)} AS crc FROM corpus", CRC_TABLE))
def p10(s, d):
    return views.corpus(s, d).select("comment_id", sc.row_crc(*sc.COLUMNS).alias("crc"))


MD5 = "CAST(('0x' || substr(md5(concat_ws(chr(31), {})), 1, 15)) AS BIGINT)"
MD5_CORPUS = MD5.format("comment_id, content, author, author_email, author_url, author_ip, agent, type")


@query("p10_row_hash", sql(f"SELECT comment_id, {MD5_CORPUS} AS h FROM corpus"))
def p10_hash(s, d):
    return views.corpus(s, d).select("comment_id", sc.row_hash(*sc.COLUMNS).alias("h"))


@query("p11_percent_encode", sql("SELECT comment_id, url_encode(content) AS encoded, content AS decoded FROM corpus"))
def p11(s, d):
    e = views.corpus(s, d).select("comment_id", sc.percent_encode(F.col("content")).alias("encoded"))
    return e.withColumn("decoded", sc.percent_decode(F.col("encoded")))


@query("p12_reaction", sql("SELECT comment_id, CASE WHEN type IN ('trackback', 'pingback', 'pings') THEN 'linkback' ELSE 'comment' END AS reaction FROM corpus"))
def p12(s, d):
    return views.corpus(s, d).select("comment_id", sc.reaction(F.col("type")).alias("reaction"))


@query("p13_submission", sql("SELECT comment_id, CASE WHEN reason = 'css' THEN 'decoy' ELSE 'genuine' END AS path FROM reasons"))
def p13(s, d):
    return views.reasons(s, d).select("comment_id", sc.submission(F.col("reason")).alias("path"))


@query("p14_anonymise", sql("""SELECT comment_id, CASE WHEN is_ham THEN 'Synthetic text ' || comment_id ELSE content END AS content, 'Author ' || comment_id AS author,
  'author' || comment_id || '@example.com' AS author_email, CASE WHEN is_ham THEN 'https://example.com/' ELSE author_url END AS author_url,
  CASE WHEN comment_id % 2 = 0 THEN '192.0.2.' ELSE '198.51.100.' END || (comment_id % 254 + 1) AS author_ip, agent, type FROM sample""", SAMPLE))
def p14(s, d):
    return sc.anonymise(_sample(s, d))


@query("p15_direction", sql("SELECT id, CASE WHEN status = 'spam' THEN '=> spam' ELSE '=> not spam' END AS direction FROM big_new"))
def p15(s, d):
    return views.big_new(s, d).select("id", sc.direction(F.col("status")).alias("direction"))


#: CRC-32 of an ASCII string, bit by bit.
CRC32 = (
    "xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length({0}) + 1), lambda i: CAST(ascii(substr({0}, i, 1)) AS BIGINT))), "
    "lambda c, b: list_reduce(list_prepend(xor(c, b), range(CAST(8 AS BIGINT))), lambda x, n: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"
)
EMAIL_CLUSTERS = "emails AS (SELECT comment_id, CASE WHEN trim(author_email) = '' THEN 'c:' || comment_id ELSE 'e:' || lower(trim(author_email)) END AS cluster FROM corpus)"


@query("p16_shard_of", sql(f"SELECT comment_id, cluster, CAST({CRC32.format('cluster')} % 8 AS INTEGER) AS shard FROM emails", EMAIL_CLUSTERS))
def p16(s, d):
    return cl.assign_shards(cl.email_clusters(views.corpus(s, d)), 8)


@query("p17_mod_shard", sql("SELECT comment_id, CAST(comment_id % 6 AS INTEGER) AS shard FROM corpus"))
def p17(s, d):
    return views.corpus(s, d).select("comment_id", sc.mod_shard(F.col("comment_id"), 6).alias("shard"))


@query("p18_rule_hits", sql("SELECT id, unnest(string_split(reason, ',')) AS rule FROM big_new WHERE reason IS NOT NULL UNION ALL SELECT id, NULL FROM big_new WHERE reason IS NULL"))
def p18(s, d):
    return sc.rule_hits(views.big_new(s, d))


@query("p20_base64", sql("SELECT comment_id, base64(encode(content)) AS b, content AS back FROM corpus"))
def p20(s, d):
    b = views.corpus(s, d).select("comment_id", sc.b64(F.col("content")).alias("b"))
    return b.withColumn("back", sc.unb64(F.col("b")))


@query("p21_hard_fp", sql("SELECT path, sha256(concat_ws('|', schema, commit_sha, corpus_token, shard_mode)) AS fp FROM catalog"))
def p21(s, d):
    return views.catalog(s, d).select("path", sc.hard_fp("schema", "commit_sha", "corpus_token", "shard_mode").alias("fp"))


VER = r"""ver AS (SELECT version, CAST(p[1] AS INTEGER) AS a, CAST(p[2] AS INTEGER) AS b, CAST(p[3] AS INTEGER) AS c, rest = '' AS stable, regexp_extract(rest, '^-([a-z]+)', 1) AS kind,
  coalesce(CAST(nullif(regexp_extract(rest, '([0-9]+)$', 1), '') AS INTEGER), 0) AS n, s AS t FROM (SELECT version, s, string_split(string_split(s, '-')[1], '.') AS p, substr(s, length(string_split(s, '-')[1]) + 1) AS rest
  FROM (SELECT version, ltrim(version, 'v') AS s FROM versions)))"""


@query("p22_version_key", sql("SELECT version, a AS major, b AS minor, c AS patch, stable, kind, n AS number FROM ver", VER))
def p22(s, d):
    k = views.versions(s, d).select("version", sc.version_key(F.col("version")).alias("k"))
    return k.select("version", *[F.col(f"k.{c}").alias(c) for c in ("major", "minor", "patch", "stable", "kind", "number")])


@query("p23_options_fp", "SELECT event_id, substr(sha256(props), 1, 16) AS fp FROM events")
def p23(s, d):
    return table(s, d, "events").select("event_id", sc.options_fp(F.col("props")).alias("fp"))


# --- joins -----------------------------------------------------------------------------------------------------------


@query("j1_with_meta", sql("SELECT c.comment_id, m.meta_value AS reason FROM corpus c LEFT JOIN meta m ON m.comment_id = c.comment_id AND m.meta_key = 'reason'"))
def j1(s, d):
    return joins.with_meta(views.corpus(s, d).select("comment_id"), views.meta(s, d), "reason", "reason")


@query("j2_link_original", sql("SELECT CAST(id AS BIGINT) + 10000000 AS comment_id, status, id AS original FROM verdicts_new"))
def j2(s, d):
    return joins.link_original(*views.replay(s, d))


@query("j3_shard_slice", sql("SELECT comment_id, type FROM corpus WHERE comment_id % 6 = 2"))
def j3(s, d):
    c = views.corpus(s, d).select("comment_id", "type")
    shards = c.select("comment_id", sc.mod_shard(F.col("comment_id"), 6).alias("shard"))
    return joins.shard_slice(c, shards, 2)


@query("j4_verdict_diff", sql("SELECT * FROM j", JB))
def j4(s, d):
    return joins.compared(_big(s, d))


@query("j4_bucketed_diff", sql("SELECT * FROM j", JB))
def j4_bucketed(s, d):
    old, new = _folder(s), _folder(s)
    snap.write_snapshot(views.big_old(s, d), old, {}, buckets=8)
    snap.write_snapshot(views.big_new(s, d), new, {}, buckets=8)
    return joins.compared(snap.diff_snapshots(s, old, new))


@query("j5_only_in", sql("SELECT id, 'old' AS side FROM verdicts_old WHERE id NOT IN (SELECT id FROM big_new) UNION ALL SELECT id, 'new' FROM big_new WHERE id NOT IN (SELECT id FROM verdicts_old)"))
def j5(s, d):
    a, b = views.verdicts_old(s, d), views.big_new(s, d)
    return joins.only_in(a, b).withColumn("side", F.lit("old")).unionByName(joins.only_in(b, a).withColumn("side", F.lit("new")))


@query("j6_pending", sql("SELECT comment_id FROM corpus WHERE comment_id % 3 <> 1"))
def j6(s, d):
    c = views.corpus(s, d).select("comment_id")
    return joins.pending(c, c.filter("comment_id % 3 = 1"))


@query("j7_label_flips", sql(f"SELECT j.*, coalesce(r.reason, 'unflagged') AS origin FROM j JOIN reasons r ON CAST(r.comment_id AS VARCHAR) = j.id WHERE {FLIPPED}", J))
def j7(s, d):
    return joins.label_flips(df_.flips(_diff(s, d)), views.reasons(s, d))


@query("j8_keep", sql("SELECT comment_id, author FROM corpus WHERE comment_id % 10 = 0"))
def j8(s, d):
    c = views.corpus(s, d).select("comment_id", "author")
    return joins.keep(c, sa.systematic_sample(c, 10))


@query("j9_snapshot_reason", sql("SELECT c.comment_id, CASE WHEN v.id IS NULL THEN '(unclassified)' ELSE coalesce(v.reason, '(none)') END AS snapshot_reason FROM corpus c LEFT JOIN verdicts_new v ON v.id = CAST(c.comment_id AS VARCHAR)"))
def j9(s, d):
    return joins.with_snapshot_reason(views.corpus(s, d).select("comment_id"), snap.export_verdicts(views.verdicts_new(s, d), SALT), SALT)


@query("j10_drift", sql("SELECT 'released-base' AS pair, *, round(CASE WHEN compared > 0 THEN spam_flips * 100.0 / compared ELSE 0 END, 4) AS flip_percent FROM t1 UNION ALL SELECT 'released-head', *, round(CASE WHEN compared > 0 THEN spam_flips * 100.0 / compared ELSE 0 END, 4) FROM t2",
    TOTALS.format(a="big_old", b="big_old").replace("totals AS", "t1 AS", 1), TOTALS.format(a="big_old", b="big_new").replace("totals AS", "t2 AS", 1)))
def j10(s, d):
    old = views.big_old(s, d)
    return df_.drift(old, old, views.big_new(s, d))


LOWER = "(t.a, t.b, t.c, t.stable, t.kind, t.n, t.t) < (v.a, v.b, v.c, v.stable, v.kind, v.n, v.t)"


@query("j11_baseline_for", sql(f"""SELECT version, CASE WHEN stable THEN s ELSE coalesce(p, s) END AS baseline FROM (SELECT v.version, v.stable,
  (SELECT t.version FROM tags t WHERE t.stable AND {LOWER} ORDER BY t.a DESC, t.b DESC, t.c DESC LIMIT 1) AS s,
  (SELECT t.version FROM tags t WHERE NOT t.stable AND t.a = v.a AND t.b = v.b AND t.c = v.c AND {LOWER} ORDER BY t.kind DESC, t.n DESC, t.t DESC LIMIT 1) AS p FROM ver v)""", VER, "tags AS (SELECT * FROM ver WHERE (a + c) % 3 <> 0)"))
def j11(s, d):
    v = views.versions(s, d).withColumn("k", sc.version_key(F.col("version")))
    return joins.baseline_for(v.select("version"), v.filter("(k.major + k.patch) % 3 <> 0").select("version"))


@query("j12_id_sets", sql("SELECT id, 'common' AS kind FROM verdicts_old WHERE id IN (SELECT id FROM big_new) UNION ALL SELECT id, 'missing' FROM verdicts_old WHERE id NOT IN (SELECT id FROM big_new)"))
def j12(s, d):
    a, b = views.verdicts_old(s, d), views.big_new(s, d)
    return joins.common_ids(a, b).withColumn("kind", F.lit("common")).unionByName(joins.missing_ids(a, b).withColumn("kind", F.lit("missing")))


# --- aggregates ------------------------------------------------------------------------------------------------------


@query("a1_summary", sql(SUMMARY, TOTALS.format(a="big_old", b="big_new")))
def a1(s, d):
    return df_.summary(_big(s, d))


@query("a1_summary_documents", sql(SUMMARY, TOTALS.format(a="verdicts_old", b="verdicts_new")))
def a1_documents(s, d):
    return df_.summary(_diff(s, d))


@query("a2_flips", sql(f"SELECT * FROM j WHERE {FLIPPED}", J))
def a2(s, d):
    return df_.flips(_diff(s, d))


@query("a2_reason_diffs", sql(f"SELECT * FROM j WHERE {CHANGED}", JB))
def a2_reasons(s, d):
    return df_.reason_diffs(_big(s, d))


@query("a3_reason_transitions", sql(f"SELECT coalesce(old_reason, '(none)') AS old_reason, coalesce(new_reason, '(none)') AS new_reason, count(*) AS n FROM j WHERE {CHANGED} GROUP BY ALL", JB))
def a3(s, d):
    return df_.reason_transitions(_big(s, d))


@query("a4_flip_origins", sql(f"SELECT coalesce(r.reason, 'unflagged') AS origin, CASE WHEN new_status = 'spam' THEN '=> spam' ELSE '=> not spam' END AS direction, count(*) AS n FROM j JOIN reasons r ON CAST(r.comment_id AS VARCHAR) = j.id WHERE {FLIPPED} GROUP BY ALL", J))
def a4(s, d):
    return df_.flip_origins(j7(s, d))


PRINT = "SELECT md5(concat_ws(':', count(*), coalesce(sum(h), 0), coalesce(bit_xor(h), 0))) AS fingerprint FROM (SELECT {} AS h FROM {})"


@query("a5_corpus_fingerprint", sql(PRINT.format(MD5_CORPUS, "corpus")))
def a5(s, d):
    return ag.corpus_fingerprint(views.corpus(s, d), sc.COLUMNS)


def _pad_sql(key: str, byte: int) -> str:
    """The key (64 ASCII characters at most) as 64 bytes, each xor ``byte``, in hex."""
    return f"array_to_string(list_transform(range(1, 65), lambda i: format('{{:02x}}', xor(CASE WHEN i <= length({key}) THEN ascii(substr({key}, i, 1)) ELSE 0 END, {byte}))), '')"


def _hmac_sql(key: str, message: str) -> str:
    return f"sha256(unhex({_pad_sql(key, 92)}) || unhex(sha256(unhex({_pad_sql(key, 54)}) || encode({message}))))"


@query("p9_corpus_salt", sql(f"SELECT comment_id, substr({_hmac_sql('salt', chr(39) + 'id:' + chr(39) + ' || comment_id')}, 1, 16) AS pid, substr({_hmac_sql('salt', repr('salt-check'))}, 1, 16) AS salt_check, substr({_hmac_sql('fingerprint', repr('corpus-token'))}, 1, 8) AS token FROM corpus CROSS JOIN salts",
    f"print AS ({PRINT.format(MD5_CORPUS, 'corpus')})", "keyed AS (SELECT fingerprint, fingerprint || chr(0) || 'extra' AS k FROM print)", f"salts AS (SELECT fingerprint, {_hmac_sql('k', repr('verdict-salt'))} AS salt FROM keyed)"))
def p9_corpus(s, d):
    c = views.corpus(s, d)
    fingerprint = ag.corpus_fingerprint(c, sc.COLUMNS).first()["fingerprint"]
    salt = sc.derive_salt(fingerprint, "extra")
    return c.select("comment_id", sc.pseudonym(F.col("comment_id"), salt).alias("pid"), F.lit(sc.salt_check(salt)).alias("salt_check"), F.lit(sc.corpus_token(fingerprint)).alias("token"))


@query("a6_content_digest", sql(PRINT.format(MD5.format("id, status, coalesce('=' || reason, '-')"), "big_new")))
def a6(s, d):
    return ag.content_digest(views.big_new(s, d))


@query("a6_folded_digest", ORACLE["a6_content_digest"])
def a6_folded(s, d):
    path = _folder(s)
    snap.write_snapshot(views.big_new(s, d), path, {})
    return ag.folded_digest(snap.read_files(s, path))


SIZES = "sizes AS (SELECT CAST(g AS INTEGER) AS shard, (SELECT count(*) FROM corpus WHERE comment_id % 12 = g AND comment_id % 12 < 9) AS rows FROM (SELECT unnest(range(12)) AS g))"


def _sizes(s, d):
    shards = views.corpus(s, d).select(sc.mod_shard(F.col("comment_id"), 12).alias("shard")).filter("shard < 9")
    return cl.shard_sizes(shards, 12)


@query("a7_shard_sizes", sql("SELECT * FROM sizes", SIZES))
def a7(s, d):
    return _sizes(s, d)


@query("a8_shard_skew", sql("SELECT max(rows) AS largest, CAST(sum(rows) AS BIGINT) AS total, count(*) AS shards, round(max(rows) / sum(rows), 6) AS share, round(max(rows) * count(*) / sum(rows), 6) AS ratio, max(rows) * count(*) / sum(rows) > 2 AS warn FROM sizes", SIZES))
def a8(s, d):
    return cl.skew(_sizes(s, d))


STRATA = f"""strata AS (SELECT c.comment_id, coalesce(nullif(r.reason, ''), 'ham') AS old_reason, CASE WHEN v.id IS NULL THEN '(unclassified)' ELSE coalesce(v.reason, '(none)') END AS new_reason,
  CASE WHEN type = '' THEN 'comment' ELSE type END AS type, CASE WHEN regexp_matches(content, '{SPACELESS}') THEN 'spaceless' ELSE 'latin' END AS script
  FROM corpus c LEFT JOIN reasons r ON c.comment_id = r.comment_id LEFT JOIN verdicts_new v ON v.id = CAST(c.comment_id AS VARCHAR))"""
STRIDE = """chosen AS (SELECT comment_id FROM (SELECT *, row_number() OVER (PARTITION BY old_reason, new_reason, type, script ORDER BY comment_id) - 1 AS p, count(*) OVER (PARTITION BY old_reason, new_reason, type, script) AS size FROM strata)
  WHERE old_reason NOT IN ('css', 'ham') OR size <= 7 OR list_contains(list_transform(range(7), lambda i: CAST(floor(i * (CAST(size AS DOUBLE) / 7)) AS BIGINT)), p))"""


def _strata(s, d):
    r = joins.with_snapshot_reason(views.corpus(s, d).select("comment_id"), views.verdicts_new(s, d))
    return sa.strata(views.corpus(s, d), views.reasons(s, d), r)


def _chosen(st):
    return sa.stratified_sample(st, 7, F.col("old_reason").isin("css", "ham"))


@query("a9_strata_report", sql("SELECT old_reason, new_reason, type, script, count(*) AS size, count(c.comment_id) AS kept FROM strata s LEFT JOIN chosen c ON s.comment_id = c.comment_id GROUP BY ALL", STRATA, STRIDE))
def a9(s, d):
    st = materialise(_strata(s, d))
    return sa.strata_report(st, _chosen(st))


TYPED = "typed AS (SELECT coalesce(r.reason, '(ham)') AS reason, CASE WHEN c.type = '' THEN 'comment' ELSE c.type END AS type, c.comment_id FROM corpus c JOIN reasons r ON c.comment_id = r.comment_id)"


def _typed(s, d):
    return _sample(s, d).select(sc.origin_label(F.col("reason"), "(ham)").alias("reason"), sc.norm_type(F.col("type")).alias("type"), "comment_id")


@query("a10_type_counts", sql("SELECT reason, CAST(sum(n) AS BIGINT) AS rows, string_agg(type || ' x' || n, ', ' ORDER BY type || ' x' || n) AS types FROM (SELECT reason, type, count(*) AS n FROM typed GROUP BY ALL) GROUP BY reason", TYPED))
def a10(s, d):
    return sa.type_counts(_typed(s, d))


@query("a11_one_per_id", sql("SELECT meta_id, comment_id, meta_key, meta_value FROM (SELECT *, row_number() OVER (PARTITION BY comment_id ORDER BY meta_id) AS k FROM meta) WHERE k = 1"))
def a11(s, d):
    return joins.one_per_id(views.meta(s, d))


@query("a12_run_counters", sql("SELECT count(*) AS seen, count(v.id) AS processed, count(*) FILTER (WHERE v.id IS NULL) AS skipped, round(count(v.id) * 60 / 120, 1) AS per_minute FROM corpus c LEFT JOIN verdicts_new v ON v.id = CAST(c.comment_id AS VARCHAR)"))
def a12(s, d):
    return ag.run_counters(views.corpus(s, d), views.verdicts_new(s, d), 120.0)


@query("a12_observed_counters", sql("SELECT count(*) AS seen, count(v.id) AS processed, count(*) - count(v.id) AS skipped, count(*) FILTER (status = 'spam') AS spam FROM corpus c LEFT JOIN verdicts_new v ON v.id = CAST(c.comment_id AS VARCHAR)"))
def a12_observed(s, d):
    path = _folder(s)
    got = ag.counted_run(views.corpus(s, d), lambda c: rules.classify(c, rules.new_rules()), lambda v: v.write.parquet(path))
    return s.createDataFrame([got], "seen long, processed long, skipped long, spam long")


@query("a13_reason_distribution", sql("SELECT reason, n, round(n * 100.0 / sum(n) OVER (), 4) AS share FROM (SELECT reason, count(*) AS n FROM big_new GROUP BY reason)"))
def a13(s, d):
    return ag.reason_distribution(views.big_new(s, d))


@query("a14_catch_rate", sql("SELECT n, caught, n - caught AS missed, round(p, 6) AS rate, round(sqrt(p * (1 - p) / n), 8) AS error FROM (SELECT count(*) AS n, count(*) FILTER (WHERE status = 'spam') AS caught, count(*) FILTER (WHERE status = 'spam') / count(*) AS p FROM big_new)"))
def a14(s, d):
    return ag.catch_rate(views.big_new(s, d))


@query("a14_catch_by_rule", sql("SELECT rule, count(*) AS n, round(count(*) / (SELECT count(*) FROM verdicts_new), 6) AS rate FROM (SELECT unnest(string_split(reason, ',')) AS rule FROM verdicts_new WHERE status = 'spam') GROUP BY rule"))
def a14_rules(s, d):
    return ag.catch_by_rule(views.verdicts_new(s, d))


@query("a15_crosstab", sql("SELECT verdict, origin, count(*) AS n FROM (SELECT CASE WHEN v.status = 'spam' THEN 'spam' ELSE 'ham' END AS verdict, coalesce(nullif(r.reason, ''), 'unflagged') AS origin FROM verdicts_new v JOIN reasons r ON v.id = CAST(r.comment_id AS VARCHAR)) GROUP BY CUBE (verdict, origin)"))
def a15(s, d):
    return ag.crosstab(views.verdicts_new(s, d), views.reasons(s, d))


@query("a16_latency_profile", "SELECT count(value) AS n, round(quantile_cont(value, 0.5), 6) AS median, round(avg(value), 6) AS mean, count(*) FILTER (WHERE value >= 100) AS slow, round(coalesce(sum(value) FILTER (WHERE value >= 100), 0) / sum(value), 6) AS slow_share, round(max(value), 6) AS worst FROM events")
def a16(s, d):
    return ag.latency_profile(table(s, d, "events"), "value", 100.0)


@query("a17_gains", sql(f"SELECT rule, count(*) AS n FROM (SELECT unnest(string_split(new_reason, ',')) AS rule FROM j WHERE {FLIPPED} AND new_status = 'spam') GROUP BY rule", J))
def a17(s, d):
    return df_.gains(_diff(s, d))


@query("a18_row_count", "SELECT count(*) AS n FROM documents")
def a18(s, d):
    return ag.row_count(views.corpus(s, d))


@query("a19_false_positives", sql("SELECT rule, count(*) AS n FROM (SELECT unnest(string_split(v.reason, ',')) AS rule FROM verdicts_new v JOIN reasons r ON v.id = CAST(r.comment_id AS VARCHAR) WHERE coalesce(r.reason, '') = '' AND v.status = 'spam') GROUP BY rule"))
def a19(s, d):
    return ag.false_positives(views.verdicts_new(s, d), views.reasons(s, d))


# --- windows and samples ---------------------------------------------------------------------------------------------


@query("w1_top_n_per_group", sql("SELECT reason, type, comment_id, k FROM (SELECT *, row_number() OVER (PARTITION BY reason, type ORDER BY comment_id) AS k FROM typed) WHERE k <= 10", TYPED))
def w1(s, d):
    return sa.top_n_per_group(_typed(s, d), ["reason", "type"], 10)


@query("w2_stratified_sample", sql("SELECT * FROM strata WHERE comment_id IN (SELECT comment_id FROM chosen)", STRATA, STRIDE))
def w2(s, d):
    return _chosen(materialise(_strata(s, d))).select("comment_id", "old_reason", "new_reason", "type", "script")


TEN = "ten AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY reason, type ORDER BY comment_id) AS k FROM typed) WHERE k <= 10)"


@query("w3_renumber", sql("SELECT comment_id, reason, type, row_number() OVER (ORDER BY reason, type, comment_id) AS new_id FROM ten", TYPED, TEN))
def w3(s, d):
    return sa.renumber(w1(s, d).drop("k"), ["reason", "type", "comment_id"])


@query("w4_rotate_bodies", sql("SELECT comment_id, 'body ' || ((row_number() OVER (ORDER BY comment_id)) % 10) AS body FROM typed WHERE reason = '(ham)'", TYPED))
def w4(s, d):
    ham = sa.renumber(_typed(s, d).filter("reason = '(ham)'"), ["comment_id"], "n")
    return sa.rotate(ham, [f"body {i}" for i in range(10)]).select("comment_id", "body")


@query("w5_approved_address", """SELECT event_id, user_id, e AS spam, coalesce(f < event_id, false) AS trusted, e AND NOT coalesce(f < event_id, false) AS final_spam
  FROM (SELECT event_id, user_id, event_type = 'error' AS e, min(CASE WHEN event_type <> 'error' THEN event_id END) OVER (PARTITION BY user_id) AS f FROM events)""")
def w5(s, d):
    e = table(s, d, "events").select("event_id", "user_id", (F.col("event_type") == "error").alias("spam"))
    return ordered.approved_email(e, "user_id", "event_id", "spam").select("event_id", "user_id", "spam", "trusted", "final_spam")


@query("w6_pick_released", sql("""SELECT c.commit_sha, c.corpus_token, c.options_fp, min({'t': coalesce(k.created_at, ''), 'p': k.path}).p AS path FROM (SELECT DISTINCT commit_sha, corpus_token, options_fp FROM catalog WHERE options_fp IS NOT NULL) c
  JOIN catalog k ON k.commit_sha = c.commit_sha AND k.corpus_token = c.corpus_token AND (k.options_fp IS NULL OR k.options_fp = c.options_fp) GROUP BY ALL"""))
def w6(s, d):
    c = views.catalog(s, d)
    return cat.pick_released(c, c.filter("options_fp is not null").select("commit_sha", "corpus_token", "options_fp").distinct())


@query("w7_half_mass", "SELECT count(*) AS n, (SELECT count(value) FROM events) AS total_rows, round(count(*) / (SELECT count(value) FROM events), 6) AS share FROM (SELECT value, sum(value) OVER (ORDER BY value DESC, event_id ROWS UNBOUNDED PRECEDING) AS r FROM events WHERE value IS NOT NULL) WHERE r - value < (SELECT sum(value) FROM events) / 2")
def w7(s, d):
    return ag.half_mass(table(s, d, "events"), "value", "event_id")


@query("w8_limit_per_shard", sql("SELECT comment_id, shard FROM (SELECT comment_id, CAST(comment_id % 6 AS INTEGER) AS shard, row_number() OVER (PARTITION BY comment_id % 6 ORDER BY comment_id) AS k FROM corpus) WHERE k <= 20"))
def w8(s, d):
    c = views.corpus(s, d).select("comment_id", sc.mod_shard(F.col("comment_id"), 6).alias("shard"))
    return sa.limit_per_shard(c, 20)


@query("w9_list_flips", sql(f"SELECT * FROM j WHERE {FLIPPED} ORDER BY id LIMIT 50", JB))
def w9(s, d):
    return df_.list_flips(df_.flips(_big(s, d)), 50)


@query("w9_more_flips", sql(f"SELECT greatest(count(*) - 50, 0) AS more FROM j WHERE {FLIPPED}", JB))
def w9_more(s, d):
    return df_.more_flips(df_.flips(_big(s, d)), 50)


@query("w10_bytewise_order", sql("SELECT count(*) AS rows, min(id) AS least, max(id) AS greatest, true AS rising FROM big_new"))
def w10(s, d):
    path = _folder(s)
    snap.write_snapshot(views.big_new(s, d), path, {})
    return snap.bytewise(snap.read_files(s, path)).select("rows", "least", "greatest", "rising")


@query("w10_lookup", sql("SELECT * FROM big_new WHERE id IN (SELECT CAST(max(l_orderkey) AS VARCHAR) FROM lineitem) OR id IN ('1', '7', '33')"))
def w10_lookup(s, d):
    path = _folder(s)
    snap.write_snapshot(views.big_new(s, d), path, {})
    last = table(s, d, "lineitem").agg(F.max("l_orderkey")).first()[0]
    return snap.lookup(s, path, ["1", "7", "33", str(last)])


@query("w11_systematic_sample", sql(CORPUS8 + " WHERE comment_id % 10 = 0"))
def w11(s, d):
    return sa.systematic_sample(views.corpus(s, d), 10).select(*sc.COLUMNS)


# --- clusters --------------------------------------------------------------------------------------------------------

CLUSTERS = "clusters AS (SELECT comment_id, min(comment_id) OVER (PARTITION BY comment_id // 48) AS first_id FROM corpus)"


@query("c1_identity_clusters", sql("SELECT * FROM clusters", CLUSTERS))
def c1(s, d):
    c = cl.identity_clusters(views.corpus(s, d))
    return c.join(c.groupBy("cluster").agg(F.min("comment_id").alias("first_id")), "cluster").select("comment_id", "first_id")


@query("c2_email_clusters", sql("SELECT comment_id, CASE WHEN trim(author_email) = '' THEN 'c:' || comment_id ELSE 'e:' || lower(trim(author_email)) END AS cluster FROM corpus"))
def c2(s, d):
    return cl.email_clusters(views.corpus(s, d))


@query("c3_assign_shards", sql(f"SELECT comment_id, cluster, CAST({CRC32.format('cluster')} % 8 AS INTEGER) AS shard FROM named JOIN (SELECT first_id, min(key) AS cluster FROM keys JOIN clusters USING (comment_id) GROUP BY first_id) USING (first_id)",
    KEYS, CLUSTERS, "named AS (SELECT comment_id, first_id FROM clusters)"))
def c3(s, d):
    return cl.assign_shards(cl.identity_clusters(views.corpus(s, d)), 8)


@query("c4_mode_fits", sql("SELECT path, shard_mode, workers, shard_mode IN ('identity', 'email') AND NOT (shard_mode = 'email' AND workers = '4') AS fits FROM (SELECT path, shard_mode, soft_workers AS workers FROM catalog)"))
def c4(s, d):
    c = views.catalog(s, d).select("path", "shard_mode", F.col("soft")["workers"].alias("workers"))
    own = F.when(F.col("workers") == "4", F.array(F.lit("db-spam"), F.lit("bbcode"))).otherwise(F.array(F.lit("bbcode")))
    return c.select("path", "shard_mode", "workers", cl.mode_fits(F.col("shard_mode"), own).alias("fits"))


@query("c5_cluster_profile", sql("SELECT size, count(*) AS n, round(max(max(size)) OVER () / sum(sum(size)) OVER (), 6) AS largest_share FROM (SELECT first_id, count(*) AS size FROM clusters GROUP BY first_id) GROUP BY size", CLUSTERS))
def c5(s, d):
    return cl.cluster_profile(cl.identity_clusters(views.corpus(s, d)))


# --- rules -----------------------------------------------------------------------------------------------------------


@query("r1_classify", sql("SELECT * FROM verdicts_new"))
def r1(s, d):
    return rules.classify(views.corpus(s, d), rules.new_rules())


@query("r2_from_options", sql("""SELECT CAST(comment_id AS VARCHAR) AS id, CASE WHEN r IS NULL THEN '1' ELSE 'spam' END AS status, r AS reason FROM (SELECT h.comment_id, nullif(concat_ws(',', CASE WHEN e AND type IN ('', 'comment') THEN 'r-email' END, CASE WHEN q THEN 'r-ip' END), '') AS r FROM hits h JOIN corpus c ON c.comment_id = h.comment_id)"""))
def r2(s, d):
    return rules.classify(views.corpus(s, d), rules.new_rules().from_options({"comment": {"r-email": "on"}, "general": {"r-ip": "on"}}))


def _full_rules(s, d):
    c = views.corpus(s, d).join(views.reasons(s, d).withColumnRenamed("reason", "history"), "comment_id")
    rs = rules.Ruleset((rules.honeypot(lambda: sc.submission(F.col("history"))), *rules.new_rules().rules, rules.bbcode(), rules.language(["en", "de", "fr"]), rules.title_is_name("src3")))
    return c, rs


FULL = """full_ AS (SELECT h.comment_id, CASE WHEN r.reason = 'css' THEN 'decoy' END AS final, nullif(concat_ws(',', CASE WHEN e THEN 'r-email' END, CASE WHEN q THEN 'r-ip' END, CASE WHEN p THEN 'r-phone' END,
  CASE WHEN type IN ('', 'comment') AND regexp_matches(content, '\\[(url|link|img)[=\\]]') THEN 'bbcode' END,
  CASE WHEN length(content) >= 10 AND lang NOT IN ('en', 'de', 'fr') THEN 'language' END, CASE WHEN author = 'src3' AND type IN ('trackback', 'pingback') THEN 'title_is_name' END), '') AS rest
  FROM hits h JOIN corpus c ON c.comment_id = h.comment_id JOIN reasons r ON r.comment_id = h.comment_id)"""
VERDICT = "SELECT CAST(comment_id AS VARCHAR) AS id, CASE WHEN {r} IS NULL THEN '1' ELSE 'spam' END AS status, {r} AS reason FROM full_"


@query("r3_final_first", sql(VERDICT.format(r="coalesce(final, rest)"), FULL))
def r3(s, d):
    return rules.classify(*_full_rules(s, d))


@query("r4_without_rule", sql("SELECT CAST(comment_id AS VARCHAR) AS id, CASE WHEN e OR p THEN 'spam' ELSE '1' END AS status, nullif(concat_ws(',', CASE WHEN e THEN 'r-email' END, CASE WHEN p THEN 'r-phone' END), '') AS reason FROM hits"))
def r4(s, d):
    return rules.classify(views.corpus(s, d), rules.new_rules().without("r-ip"))


@query("r5_honeypot", sql("SELECT CAST(h.comment_id AS VARCHAR) AS id, CASE WHEN r.reason = 'css' THEN 'spam' ELSE '1' END AS status, CASE WHEN r.reason = 'css' THEN 'decoy' END AS reason FROM hits h JOIN reasons r ON h.comment_id = r.comment_id"))
def r5(s, d):
    c, rs = _full_rules(s, d)
    return rules.classify(c, rules.Ruleset(rs.rules[:1]))


@query("r6_patterns", sql(f"SELECT CAST(comment_id AS VARCHAR) AS id, CASE WHEN r IS NULL THEN '1' ELSE 'spam' END AS status, r AS reason FROM (SELECT comment_id, nullif(concat_ws(',', CASE WHEN regexp_matches(content, '{rules.PHONE}') THEN 'phone' END, CASE WHEN type IN ('', 'comment') AND regexp_matches(content, 'the') THEN 'word' END), '') AS r FROM corpus WHERE content <> '')"))
def r6(s, d):
    return rules.classify(views.corpus(s, d), rules.Ruleset((rules.regexp("phone", rules.PHONE), rules.regexp("word", "the", reactions=("comment",)))))


@query("r7_language", sql("SELECT CAST(comment_id AS VARCHAR) AS id, CASE WHEN x THEN 'spam' ELSE '1' END AS status, CASE WHEN x THEN 'language' END AS reason FROM (SELECT comment_id, length(content) >= 10 AND lang NOT IN ('en', 'fr') AS x FROM corpus WHERE content <> '')"))
def r7(s, d):
    return rules.classify(views.corpus(s, d), rules.Ruleset((rules.language(["en", "fr"]),)))


def _small_words(code: str) -> str:
    own = ", ".join(f"'{w}'" for w in sorted(set(rules.STOP_WORDS[code].split())))
    return f"struct_pack(n := len(list_filter(w, lambda x: list_contains([{own}], x))), place := {-sorted(rules.STOP_WORDS).index(code)}, code := '{code}')"


@query("r7_detect_language", sql(f"SELECT comment_id, lang, CASE WHEN best.n > 0 THEN best.code ELSE 'und' END AS found FROM (SELECT comment_id, lang, list_max([{', '.join(map(_small_words, sorted(rules.STOP_WORDS)))}]) AS best"
    r" FROM (SELECT comment_id, lang, regexp_extract_all(lower(coalesce(content, '')), '[^\x20\x09-\x0D]+') AS w FROM corpus))"))
def r7_detect(s, d):
    return views.corpus(s, d).select("comment_id", "lang", rules.detect_language(F.col("content")).alias("found"))


@query("r8_front_door", sql("SELECT comment_id FROM corpus WHERE content <> '' AND (author_email <> '' OR type IN ('trackback', 'pingback'))"))
def r8(s, d):
    return rules.front_door(views.corpus(s, d), need_email=True).select("comment_id")


@query("r9_title_is_name", sql("SELECT CAST(comment_id AS VARCHAR) AS id, CASE WHEN x THEN 'spam' ELSE '1' END AS status, CASE WHEN x THEN 'title_is_name' END AS reason FROM (SELECT comment_id, author = 'src3' AND type IN ('trackback', 'pingback') AS x FROM corpus WHERE content <> '')"))
def r9(s, d):
    return rules.classify(views.corpus(s, d), rules.Ruleset((rules.title_is_name("src3"),)))


SEEDS = "seeds AS (SELECT CAST(id AS BIGINT) AS comment_id FROM verdicts_new WHERE status = 'spam')"


def _seeds(s, d):
    return views.verdicts_new(s, d).filter("status = 'spam'").select(F.col("id").cast("long").alias("comment_id"))


@query("r10_repeat_rule", sql("SELECT comment_id, comment_id IN (SELECT comment_id FROM seeds) AS seed FROM spam", KEYS, SEEDS,
    "spam AS (SELECT comment_id FROM seeds UNION SELECT b.comment_id FROM spam s JOIN keys a ON a.comment_id = s.comment_id JOIN keys b ON a.key = b.key AND b.comment_id > s.comment_id)", recursive=True))
def r10(s, d):
    return ordered.db_spam(views.corpus(s, d), _seeds(s, d))


# a fold over the ids of each cluster, all clusters abreast, with the spam keys and approved e-mails so far
@query("r11_ordered_rules", sql("SELECT comment_id, content_spam, repeat, trusted, spam FROM fold WHERE n > 0", KEYS, SEEDS, CLUSTERS,
    "own AS (SELECT comment_id, list(key) AS keys, max(key) FILTER (key LIKE 'e:%') AS email FROM keys GROUP BY comment_id)",
    "r AS (SELECT comment_id, first_id, row_number() OVER (PARTITION BY first_id ORDER BY comment_id) AS n, keys, email, comment_id IN (SELECT comment_id FROM seeds) AS content_spam FROM clusters LEFT JOIN own USING (comment_id))",
    "fold AS (SELECT DISTINCT CAST(0 AS BIGINT) AS n, first_id, CAST(NULL AS BIGINT) AS comment_id, false AS content_spam, false AS repeat, false AS trusted, false AS spam, CAST([] AS VARCHAR[]) AS bad, CAST([] AS VARCHAR[]) AS good FROM clusters"
    " UNION ALL SELECT n, first_id, comment_id, content_spam, repeat, trusted, spam, CASE WHEN spam THEN list_concat(bad, keys) ELSE bad END, CASE WHEN NOT spam AND email IS NOT NULL THEN list_append(good, email) ELSE good END"
    " FROM (SELECT *, NOT trusted AND (content_spam OR repeat) AS spam FROM (SELECT r.n, r.first_id, r.comment_id, r.content_spam, r.keys, r.email, f.bad, f.good, coalesce(list_has_any(f.bad, r.keys), false) AS repeat, coalesce(list_contains(f.good, r.email), false) AS trusted"
    " FROM fold f JOIN r ON r.first_id = f.first_id AND r.n = f.n + 1)))", recursive=True))
def r11(s, d):
    return ordered.ordered_rules(materialise(views.corpus(s, d).drop("content", "lang")), _seeds(s, d))


@query("r12_bypass", sql(VERDICT.format(r="rest"), FULL))
def r12(s, d):
    c, rs = _full_rules(s, d)
    return rules.classify(rules.bypass(c, "history"), rs)


@query("r13_user_rule", sql("SELECT CAST(comment_id AS VARCHAR) AS id, CASE WHEN length(content) > 5000 THEN 'spam' ELSE '1' END AS status, CASE WHEN length(content) > 5000 THEN 'long' END AS reason FROM corpus WHERE content <> ''"))
def r13(s, d):
    return rules.classify(views.corpus(s, d), rules.Ruleset().add("long", "length(content) > 5000"))


# --- gates and catalogue ---------------------------------------------------------------------------------------------


@query("g1_comparable", sql("SELECT old_total, new_total, compared, CAST(floor(0.99 * least(old_total, new_total)) AS BIGINT) AS least, compared > 0 AND compared >= floor(0.99 * least(old_total, new_total)) AS comparable FROM totals", TOTALS.format(a="big_old", b="big_new")))
def g1(s, d):
    return gates.comparable(df_.summary(_big(s, d)))


@query("g2_gate", sql("SELECT spam_flips, spam_flips > 0 AS fails FROM totals", TOTALS.format(a="verdicts_old", b="verdicts_new")))
def g2(s, d):
    return gates.flipped(df_.summary(_diff(s, d)))


@query("g9_nonempty", sql("SELECT count(*) AS n, count(*) > 0 AS ok FROM verdicts_new"))
def g9(s, d):
    return gates.nonempty(views.verdicts_new(s, d))


@query("g3_usable", sql("SELECT path, CASE WHEN schema <> 2 THEN 'schema' WHEN commit_sha IS DISTINCT FROM 'commit7' THEN 'commit' WHEN salt_check <> 'check1' THEN 'salt' END AS refusal FROM catalog"))
def g3(s, d):
    return cat.usable(views.catalog(s, d), 2, "commit7", "check1").select("path", "refusal")


@query("g4_soft_drift", sql("SELECT path, 'workers' AS name, soft_workers AS recorded, '4' AS current FROM catalog WHERE soft_workers <> '4' UNION ALL SELECT path, 'minor', soft_minor, '8.1' FROM catalog WHERE soft_minor <> '8.1'"))
def g4(s, d):
    return cat.soft_drift(views.catalog(s, d), {"workers": "4", "minor": "8.1", "unrecorded": "x"})


@query("g5_publishable", sql("SELECT path, salt_check <> '' AND shard_mode IN ('identity', 'email') AS publishable FROM catalog"))
def g5(s, d):
    return views.catalog(s, d).select("path", gates.is_publishable().alias("publishable"))


@query("g6_duplicated", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def g6(s, d):
    return gates.duplicated(table(s, d, "lineitem").select("l_orderkey"), "l_orderkey")


@query("g7_cached", sql("SELECT r.label, coalesce(r.git_sha = l.git_sha AND r.comment_count = l.comment_count, false) AS hit FROM latest r LEFT JOIN (SELECT * FROM latest WHERE comment_count < 5) l ON r.label = l.label", PASSES, f"latest AS ({LATEST})"))
def g7(s, d):
    r = src.latest_per_label(_passes(s, d))
    return cat.cached(r, r.filter("comment_count < 5"))


@query("g8_released_state", sql("SELECT path AS version, CASE WHEN created_at IS NULL THEN 'none' WHEN rows % 2 = 0 THEN 'current' ELSE 'compared' END AS state, created_at IS NOT NULL AND rows % 2 <> 0 AND rows % 5 <> 0 AS warn FROM catalog"))
def g8(s, d):
    c = views.catalog(s, d)
    picked = c.select(F.col("path").alias("version"), F.when(F.col("created_at").isNotNull(), F.col("path")).alias("path"), (F.col("rows") % 2 == 0).alias("is_current"))
    return cat.released_state(picked, c.select(F.col("path").alias("version"), (F.col("rows") % 5).alias("spam_flips")))


@query("g10_describes", sql("SELECT path, commit_sha = 'commit7' AND contains(path, corpus_token) AS ok FROM (SELECT path || CASE WHEN rows % 3 = 0 THEN corpus_token ELSE '' END AS path, commit_sha, corpus_token FROM catalog)"))
def g10(s, d):
    c = views.catalog(s, d).withColumn("path", F.concat("path", F.when(F.col("rows") % 3 == 0, F.col("corpus_token")).otherwise("")))
    return cat.describes(c, "commit7")


# --- streams, each run until it has read what is there --------------------------------------------------------------


def _stream(s: SparkSession, d: str, name: str) -> DataFrame:
    # a pattern, for the file source takes a plain path as a folder and these may be single files
    return s.readStream.schema(table(s, d, name).schema).parquet(f"{d}/{name}.parque[t]")


@query("t1_classify_stream", sql("SELECT * FROM verdicts_new"))
def t1(s, d):
    at = _folder(s)
    inc.classify_stream(views.corpus_of(_stream(s, d, "documents")), rules.new_rules(), f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return inc.read_sink(s, f"{at}/out")


def _arrive(s: SparkSession, at: str, df: DataFrame, ts: str | None = None) -> None:
    """More files of a stream; with ``ts``, a heartbeat of that time."""
    if ts is not None:
        df = s.createDataFrame([()], "").select(*[(F.lit(ts) if c == "ts" else F.lit(None)).cast(t).alias(c) for c, t in df.dtypes])
    df.write.mode("append").parquet(f"{at}/in")


def _run_to_end(s: SparkSession, at: str, out: DataFrame):
    """Run a stream until it has read what is there."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = s.conf.get(name)
    s.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        s.conf.set(name, before)
    return q


def _trust_stream(s: SparkSession, d: str, key) -> DataFrame:
    """The events in files that each hold some of all times, then a heartbeat."""
    at = _folder(s)
    e = table(s, d, "events").select("event_id", key.alias("user_id"), (F.col("event_type") == "error").alias("spam"), F.col("ts").cast("timestamp").alias("ts"))
    for k in (2, 0, 1):
        _arrive(s, at, e.filter(F.pmod(F.hash("event_id"), F.lit(3)) == k))
    _arrive(s, at, e, "2034-01-01 00:00:00")
    stream = s.readStream.schema(e.schema).parquet(f"{at}/in")
    _run_to_end(s, at, inc.approved_email_stream(stream, "user_id", "event_id", "spam", "ts", "60 days"))
    return s.read.parquet(f"{at}/out").select(F.col("id").alias("event_id"), F.col("key").alias("user_id"), "spam", "trusted", "final_spam")


@query("t2_approved_address_stream", ORACLE["w5_approved_address"])
def t2(s, d):
    return _trust_stream(s, d, F.col("user_id"))


@query("t2_rows_without_key", """SELECT event_id, u AS user_id, e AS spam, u IS NOT NULL AND coalesce(f < event_id, false) AS trusted, e AND NOT (u IS NOT NULL AND coalesce(f < event_id, false)) AS final_spam
  FROM (SELECT event_id, u, event_type = 'error' AS e, min(CASE WHEN event_type <> 'error' THEN event_id END) OVER (PARTITION BY u) AS f FROM (SELECT *, CASE WHEN user_id % 5 <> 0 THEN 'user' || user_id END AS u FROM events))""")
def t2_keys(s, d):
    return _trust_stream(s, d, F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("user"), "user_id")))


@query("t3_throughput_stream", "SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, count(*) AS n FROM events GROUP BY 1")
def t3_stream(s, d):
    at, e = _folder(s), table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    _arrive(s, at, e)
    _arrive(s, at, e, "2034-01-01 00:00:00")
    _run_to_end(s, at, inc.throughput(s.readStream.schema(e.schema).parquet(f"{at}/in"), "ts", "1 hour", "10 minutes", "event_id"))
    return s.read.parquet(f"{at}/out").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


# rows arrive in three steps; those of a window that ended before the watermark of the steps before are late
@query("t3_late_rows", sql("SELECT w AS window_start, count(*) FILTER (kept) AS n, (SELECT count(*) FROM k WHERE NOT kept) AS dropped FROM k GROUP BY w HAVING count(*) FILTER (kept) > 0",
    "e AS (SELECT ts, time_bucket(INTERVAL 1 hour, ts) AS w, CASE WHEN event_id % 10 < 6 AND ts < TIMESTAMP '2024-01-15' THEN 0 WHEN event_id % 10 < 9 THEN 1 ELSE 2 END AS step FROM events)",
    "m AS (SELECT a.step, max(b.ts) - INTERVAL 2 days AS mark FROM (SELECT DISTINCT step FROM e) a LEFT JOIN (SELECT step, max(ts) AS ts FROM e GROUP BY step) b ON b.step < a.step GROUP BY a.step)",
    "k AS (SELECT w, mark IS NULL OR w + INTERVAL 1 hour > mark AS kept FROM e JOIN m USING (step))"))
def t3_late(s, d):
    at, e, seen = _folder(s), table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts")), inc.RowsSeen()
    step = F.when((F.col("event_id") % 10 < 6) & (F.col("ts") < F.lit("2024-01-15").cast("timestamp")), 0).when(F.col("event_id") % 10 < 9, 1).otherwise(2)
    for k in range(4):
        _arrive(s, at, e.filter(step == k), "2034-01-01 00:00:00" if k == 3 else None)
        q = _run_to_end(s, at, inc.throughput(s.readStream.schema(e.schema).parquet(f"{at}/in"), "ts", "1 hour", "2 days", "event_id"))
        for p in q.recentProgress:
            seen.add(p)
    windows = s.read.parquet(f"{at}/out").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
    kept = windows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return windows.withColumn("dropped", F.lit(sum(seen.seen.values()) - kept).cast("long"))


# --- time windows ----------------------------------------------------------------------------------------------------


@query("t3_throughput", "SELECT w AS window_start, n, round(n / max(n) OVER (), 6) AS of_best FROM (SELECT time_bucket(INTERVAL 1 hour, ts) AS w, count(*) AS n FROM events GROUP BY 1)")
def t3(s, d):
    return ag.throughput(table(s, d, "events"), "ts", "1 hour")
