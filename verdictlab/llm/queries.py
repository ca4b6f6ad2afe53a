"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from verdictlab.functions.shared import materialise
from verdictlab.llm import bpe, conversations, decontam, lang_id, line_dedup, mixing, near_dedup, oracle, quality, secret_scan, sharding, substring_dedup, url_filter, vector_codes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 1, F.lit(False))
    model = lang_id.fit(docs.filter(~held_out & F.col("doc_id").isNotNull()))
    found = lang_id.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.sizes(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), 8)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    found = decontam.match(docs.select("doc_id", "text"), items)
    c = F.col("contamination")
    return found.select(
        "doc_id", c["n_words"].alias("n_words"), decontam.n_hit().alias("n_hit"),
        F.size(c["items"]).cast("long").alias("n_items"), decontam.items_digest().alias("items_sha256"),
        decontam.contaminated().alias("contaminated"),
    )


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs, secret_scan.train(secret_scan.samples(docs)))
    base, spans = F.col("secrets.base"), F.col("secrets.spans")
    return found.select(
        "doc_id", *[secret_scan.count(base, k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secret_scan.listed(base), 256).alias("base_sha256"), secret_scan.listed(spans).alias("spans"),
    )


def op5_fixed_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base spans alone, without a model."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", secret_scan.base_spans(F.coalesce("text", F.lit(""))).alias("base"))
    base = F.col("base")
    return docs.select("doc_id", *[secret_scan.count(base, k).alias(f"n_{k}") for k in ("assign", "access", "hex")], F.sha2(secret_scan.listed(base), 256).alias("base_sha256"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


#: The rules of the contract.
URL_RULES = [
    url_filter.Rule("org", "/", "allow"),
    url_filter.Rule("example.org", "/es/", "block"),
    url_filter.Rule("example.org", "/en/1", "block"),
    url_filter.Rule("com", "/fr/", "allow"),
    url_filter.Rule("com", "/de/", "block"),
]


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter.filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict", "p_block")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.line_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return found.select("doc_id", *[F.col("line_rules")[n].alias(n) for n in names])


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines shorter than a seed are left to ``op9_whole_lines``: half of all documents hold a stock line of a few words."""
    return substring_dedup.repeated_spans(_table(spark, sf_dir, "documents"), min_line_words=substring_dedup.SEED)


def op9_whole_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated texts and lines of any length, without passages inside lines."""
    found = substring_dedup.repeated_spans(_table(spark, sf_dir, "documents"), passages=False)
    return found.select("doc_id", "start", "end", "n_words", "kind", "first_doc_id", "first_start")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.fuzzy_lines(_table(spark, sf_dir, "documents"))


def _damaged(rows: DataFrame) -> DataFrame:
    """The damage of the contract: a row goes, loses its text or its marks, stands there twice, or is the user's."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.encode(F.concat(part("conv_id"), F.lit(":"), part("turn")), "UTF-8")) % 20
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(k == 0, 0).when(k == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(k == 4, "user").otherwise(part("role")).alias("role"), text.alias("text"), times).drop("col")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    fixed = conversations.repair(_damaged(rows))
    found = fixed.report.join(conversations.audits(fixed.edits).withColumnRenamed("conv", "__conv"), F.col("conv").eqNullSafe(F.col("__conv")), "left").drop("__conv")
    found = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    counts = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    import public_tokenizers

    merges = bpe.Merges(bpe.load_ranks(public_tokenizers.path(vocabulary)), public_tokenizers.PATTERN)
    found = bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), merges)
    found = bpe.decode(found.select("doc_id", "ids"), merges)
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(bpe.packed(F.col("ids")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = vector_codes.train(vectors)
    coded = vector_codes.encode(vectors, books)
    c = F.col("vector_code")
    coded = materialise(coded.select("vec_id", "label", vector_codes.hex_code(c["code"]).alias("code"), c["error"].alias("error")))
    found = vector_codes.label_errors(coded)
    return found.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def queries() -> dict:
    return {
        "op1_language_id": op1_language_id,
        "op2_mixing": op2_mixing,
        "op3_sharding": op3_sharding,
        "op4_decontamination": op4_decontamination,
        "op5_secret_scan": op5_secret_scan,
        "op5_fixed_patterns": op5_fixed_patterns,
        "op6_near_dedup": op6_near_dedup,
        "op7_url_filters": op7_url_filters,
        "op8_quality_rules": op8_quality_rules,
        "op9_substring_dedup": op9_substring_dedup,
        "op9_whole_lines": op9_whole_lines,
        "op10_line_dedup": op10_line_dedup,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_byte_bpe": op12_byte_bpe,
        "op13_vector_codes": op13_vector_codes,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    return {
        "op2_mixing": oracle.MIXING,
        "op4_decontamination": oracle.DECONTAMINATION,
        "op5_fixed_patterns": oracle.SECRET_PATTERNS,
        "op8_quality_rules": oracle.QUALITY,
        "op9_whole_lines": oracle.WHOLE_LINES,
        "op11_conversation_repair": oracle.CONVERSATIONS,
        "op13_vector_codes": oracle.VECTOR_CODES,
    }
