"""Registered queries of the operators in this folder, over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentry.llm import alignment, decontaminate, exact, lm, mixing, quality, sharding, simhash, substrings, token_files, urls, warc, whitening
from incidentry.llm.common import table, text_bytes

SHARDS = 24
KEEP_SCORE = 0.3

RULES = [
    urls.Rule("allow", "com", "/"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
]


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substrings.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), size=50)
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS)
    return rows.select(
        "doc_id",
        (text_bytes(F.col("text")) + 8).alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model(spark, sf_dir)
    rows = quality.with_scores(docs, model).withColumn("held_out", quality.held_out(F.col("doc_id")))
    return rows.select("doc_id", "held_out", "score", F.when(F.col("score") >= KEEP_SCORE, 1).otherwise(0).alias("predicted"))


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Model:
    """Fitted on labelled documents outside the held-out fifth."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~quality.held_out(F.col("doc_id")))
    return quality.fit(table(spark, sf_dir, "documents"), labels)


def op4_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact.exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.sha2("normalised", 256).alias("text_sha256"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = token_files.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, with_ids=False)
    return rows.select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document at least once, no source more than twice over; all copies with their places."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, repetitions=2.0).select("doc_id", "source", "copy", "weight", "position")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_pages(table(spark, sf_dir, "pages"))
    return records.select(
        F.regexp_extract("record_id", r"<urn:page:(.*)>", 1).cast("bigint").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.regexp_extract("refers_to", r"<urn:page:(.*)>", 1).cast("bigint").alias("refers_to"),
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs, keep_text=False).select("doc_id", "fingerprint", "component_id")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = decontaminate.judged(docs, table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "contaminated", "coverage", "item_id", "tiles", "items")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return rows.select(
        "vec_id", "component", "n", F.col("deviation").try_cast("bigint").alias("deviation"), "whitened", "explained", "identity_error"
    )


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    rows = alignment.align(docs, *paths, keep_text=False, as_text=False)
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 10 == 0, F.lit(False))
    docs = docs.withColumn("held_out", held_out)
    return lm.score_texts(docs, ~F.col("held_out"), keep_text=False)


QUERIES = {
    "op1_substrings": op1_substrings,
    "op2_shards": op2_shards,
    "op3_quality": op3_quality,
    "op4_url_verdicts": op4_url_verdicts,
    "op5_exact_groups": op5_exact_groups,
    "op6_token_files": op6_token_files,
    "op7_mixture": op7_mixture,
    "op8_warc": op8_warc,
    "op9_simhash": op9_simhash,
    "op10_decontamination": op10_decontamination,
    "op11_whitening": op11_whitening,
    "op12_alignment": op12_alignment,
    "op13_lm_scores": op13_lm_scores,
}
