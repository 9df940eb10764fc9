"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    centroids,
    chat,
    decontaminate,
    line_dedup,
    lm_score,
    mixing,
    ngram_join,
    pii,
    quality,
    ranked_search,
    reputation,
    simhash,
    warc_zip,
)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha256_of_list(items) -> F.Column:
    return F.sha2(F.array_join(F.array_sort(F.transform(items, lambda i: i.cast("string"))), ","), 256)


def op1_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_groups(_table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def op2_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc_zip.archive_round_trip(spark, _table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), ["doc_id"])
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        _sha256_of_list(F.col("items")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.rotate_perspectives(_table(spark, sf_dir, "conversations"))
    spans = F.transform("mask", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string")))
    return out.withColumn("mask", F.array_join(spans, ","))


def _span_list(spans: str) -> F.Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.find_personal_data(docs, pii.fit(docs), ["doc_id"])
    kinds = F.col("base.kind")
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{k}") for k in pii.KINDS
    ]
    return out.select(
        "doc_id", *counts, F.sha2(_span_list("base"), 256).alias("base_sha256"), _span_list("spans").alias("spans")
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The site of a document is its source."""
    out = line_dedup.drop_boilerplate(_table(spark, sf_dir, "documents"), "source")
    return out.select("doc_id", "source", "__cut.n_lines", "__cut.n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality.bucket_weights(docs, quality.clean_ids(_table(spark, sf_dir, "labels")))
    facts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]
    return quality.quality_rules(docs, weights).select("doc_id", *[f"__quality.{f}" for f in facts])


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lm_score.score_by_labels(docs, _table(spark, sf_dir, "labels"), ["doc_id"])
    losses = [F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")]
    return out.select("doc_id", "n_tokens", *losses)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", F.array("source").alias("sources"), mixing.text_size(F.col("text")).alias("size"))
    return mixing.mix_sources(sized).select("doc_id", "size", "source_size", "target", "taken")


def op10_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome of a page is the label of the document with its number."""
    labels = _table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), F.expr("quality = 1 and toxic = 0").alias("good"))
    return reputation.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), outcomes)


def op11_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranked_search.build_index(_table(spark, sf_dir, "documents"))
    return ranked_search.search(index, _table(spark, sf_dir, "benchmark"))


def op12_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_groups(_table(spark, sf_dir, "documents"), ["doc_id"])


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = centroids.cluster_vectors(_table(spark, sf_dir, "embeddings"), ["vec_id"])
    measures = ["cluster", "distance", "cluster_inertia", "inertia"]
    return out.select("vec_id", *measures, centroids.centroid_digest().alias("centroid_sha256"))


def llm_queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            op1_simhash_pigeonring,
            op2_warc_zip,
            op3_decontaminate,
            op4_chat_perspectives,
            op5_personal_data,
            op6_line_dedup,
            op7_quality_rules,
            op8_lm_score,
            op9_mixing,
            op10_url_reputation,
            op11_block_max_search,
            op12_ngram_jaccard,
            op13_centroid_clustering,
        )
    }

