"""One query per operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloom.llm import collocations, decontamination, language_id, main_text, mixing, near_dedup, quality, secret_scan, sharding, substring_dedup, token_alignment, token_output, url_filter
from rolloom.llm.oracles import ORACLES  # noqa: F401
from rolloom.llm.texts import word_count

#: The rules that the url query applies.
URL_RULES = (
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
)

#: The tokenizer of the token query: a rank file on every executor, and its free id.
TOKENIZER = token_output.Tokenizer("/opt/tokenizers/byte_bpe_50k.tiktoken", 50256)

#: The files of the two tokenizers whose tokens are aligned.
ALIGNED = token_alignment.Tokenizers("/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit("")).cast("binary")
    slim = docs.select("doc_id", (F.octet_length("text")).alias("n"), F.crc32(text).alias("text_crc32"))
    sized = slim.select("doc_id", (F.coalesce("n", F.lit(0)) + 1).cast("long").alias("size"), "text_crc32")
    placed = sharding.assign_shards(sized, F.col("size"), [F.col("doc_id"), F.col("text_crc32")], 16)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_alias_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_filter.judge(pages, "page_id", "url", URL_RULES, html="html").select(
        "page_id", "host", "path", "rule", "verdict", "alias_of"
    )


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.judge(docs, "text", ["doc_id"]).drop("clean_text")


def op4_blob_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, "doc_id", "text", secret_scan.query_ledger(spark))
    base = [rule.kind for rule in secret_scan.BASE_RULES]
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base_text = secret_scan.span_text(F.filter("spans", lambda s: s["kind"].isin(*base)))
    return found.select(
        F.col("path").alias("doc_id"),
        *[number(kind).alias(f"n_{kind}") for kind in base],
        F.sha2(base_text, 256).alias("base_sha256"),
        secret_scan.span_text(F.col("spans")).alias("spans"),
        F.col("blob"),
    )


def op5_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language_id.held_out(F.col("doc_id"))
    model = language_id.fit(docs.where(~out), "text", "lang")
    rows = docs.select("doc_id", "text", out.alias("held_out"))
    return language_id.predict(rows, "text", model).drop("text")


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return token_output.write_training_order(docs, "doc_id", "text", TOKENIZER)[0]


def op7_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    kept = substring_dedup.remove_repeats(docs, "doc_id", "text", 13)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("words"), F.md5("text").alias("md5"))
    plan = mixing.mix_plan(sized, "source", F.col("words"), F.coalesce(F.col("doc_id").cast("string"), F.col("md5")))
    return plan.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies"
    )


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return near_dedup.near_duplicates(docs, "doc_id", "text").drop("digest")


def op10_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return decontamination.contaminated(docs, "doc_id", "text", items, "item_id", "text").drop("digest")


def op11_aligned_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    aligned = token_alignment.align(docs, "text", ALIGNED)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    measured = aligned.measures.join(aligned.texts.select("key", digest), "key")
    rows = token_alignment.per_document(docs, "doc_id", "text", measured)
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    return rows.select(
        "doc_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"),
    )


def op12_parsed_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return collocations.collocations(docs, "text", "lang")


def op13_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(_table(spark, sf_dir, "pages"), "html", ["page_id", "url"])


QUERIES = {
    "op1_byte_shards": op1_byte_shards,
    "op2_alias_urls": op2_alias_urls,
    "op3_line_quality": op3_line_quality,
    "op4_blob_secrets": op4_blob_secrets,
    "op5_language_codes": op5_language_codes,
    "op6_training_order": op6_training_order,
    "op7_window_dedup": op7_window_dedup,
    "op8_source_mix": op8_source_mix,
    "op9_order_minhash": op9_order_minhash,
    "op10_latent_leaks": op10_latent_leaks,
    "op11_aligned_tokens": op11_aligned_tokens,
    "op12_parsed_phrases": op12_parsed_phrases,
    "op13_path_text": op13_path_text,
}
