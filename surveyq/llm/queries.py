"""The registered queries of this subpackage; oracles.py has their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyq.llm.conversation_trie import prefix_trie_of
from surveyq.llm.decontaminate import find_contamination
from surveyq.llm.html_text import extract_main_text
from surveyq.llm.license_scan import scan_licenses
from surveyq.llm.line_dedup import dedup_lines
from surveyq.llm.media import store_media
from surveyq.llm.near_dup import near_duplicate_ids
from surveyq.llm.oracles import ORACLES
from surveyq.llm.packing import pack
from surveyq.llm.quality import classify
from surveyq.llm.sharding import assign_shards
from surveyq.llm.snapshots import compare_documents
from surveyq.llm.token_counts import count_tokens
from surveyq.llm.toxicity import classify_toxicity

__all__ = ["ORACLES", "QUERIES"]


def _docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(*columns) if columns else docs


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_docs(spark, sf_dir)).drop("matched_words")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(_docs(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("ranges", "items")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_media(_docs(spark, sf_dir))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_docs(spark, sf_dir, "doc_id", "text")).select(
        "doc_id", F.col("line_count").alias("n_lines"), F.col("lines_dropped").alias("n_dropped"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_ids(_docs(spark, sf_dir), num=85)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_toxicity(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_documents(_docs(spark, sf_dir))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_sharding": op2_sharding,
    "op3_token_counts": op3_token_counts,
    "op4_decontaminate": op4_decontaminate,
    "op5_media": op5_media,
    "op6_line_dedup": op6_line_dedup,
    "op7_quality": op7_quality,
    "op8_main_text": op8_main_text,
    "op9_packing": op9_packing,
    "op10_near_dup": op10_near_dup,
    "op11_toxicity": op11_toxicity,
    "op12_snapshot_diff": op12_snapshot_diff,
    "op13_prefix_trie": op13_prefix_trie,
}
