"""Thin queries: one operator each, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_round_trip
from .decontamination import find_leaks
from .exact_dedup import exact_dedup
from .hard_negatives import hard_negatives
from .langid import identify_language
from .near_dedup import near_duplicates
from .quality import score_quality
from .secrets import find_secrets
from .sharding import extendible_shards
from .simhash import simhash_duplicates
from .substring_dedup import remove_repeats
from .tables import table
from .url_filters import PATTERN_RULES, SITE_RULES, filter_urls
from .whitening import whiten

SHARD_BYTES = 1 << 20


def op1_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible_shards(table(spark, sf_dir, "documents"), SHARD_BYTES).select("doc_id", "shard", "depth", "n_bytes", "shard_bytes", "shard_docs")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), SITE_RULES + PATTERN_RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op11_whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", own), F.col("id") % 100 == 0)


def op13_simhash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_quality_scores, op2_extendible_shards, op3_secret_scan, op4_benchmark_leaks, op5_exact_dedup, op6_near_duplicates, op7_language_id, op8_bpe_round_trip, op9_url_filters, op10_repeated_passages,
    op11_whitened_embeddings, op12_hard_negatives, op13_simhash_duplicates)}
