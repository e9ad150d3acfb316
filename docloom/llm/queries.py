"""Registered queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontaminate, html_text, jaccard, mixing, pii, quality, ranked_search, secrets, sharding, substring_dedup, token_counts, warc, whitening
from docloom.llm.common import scratch
from docloom.llm.oracle import ORACLES
from docloom.session import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    # a text may stand several times under one doc_id: one result row for each
    rows = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = sharding.shard(table(spark, sf_dir, "documents"), scratch(spark, "shards"))
    return sharding.shard_rows(store).select("doc_id", "shard", "shard_bytes", "run", "tier", "version")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words = secrets.learn_dictionary(docs)
    model = secrets.train(secrets.example_findings(spark, dictionary=words), dictionary=words)
    found = secrets.scan(docs, model, dictionary=words)
    return found.select("doc_id", "at", F.sha2("candidate", 256).alias("candidate_sha256"), F.length("candidate").alias("length"), "probability", "is_secret")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "end", "n_chunks", "first_doc_id", "removed_bytes")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_words_left"
    )


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get(pii.KEY_SETTING, "a key for test tables, which hold no one's data")
    return pii.pseudonymise(table(spark, sf_dir, "documents"), key).select("doc_id", "text", "n_entities", "entity_types")


def op9_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch(spark, "warc")
    archives = warc.write_archives(table(spark, sf_dir, "pages"), root)
    return warc.read_archives(archives, root, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.link_documents(table(spark, sf_dir, "documents"), words=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "n_links")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": pipeline,
        "op1_decontamination": op1_decontamination,
        "op2_sharding": op2_sharding,
        "op3_secrets": op3_secrets,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_quality": op5_quality,
        "op6_html_text": op6_html_text,
        "op7_mixing": op7_mixing,
        "op8_pii_surrogates": op8_pii_surrogates,
        "op9_warc_zip": op9_warc_zip,
        "op10_jaccard": op10_jaccard,
        "op11_whitening": op11_whitening,
        "op12_token_counts": op12_token_counts,
        "op13_ranked_search": op13_ranked_search,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
