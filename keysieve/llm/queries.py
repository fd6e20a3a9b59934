"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysieve.llm import byte_bpe, context_tree, fertility, line_dedup, mixing, nearest, oracles, simhash, substring_dedup, toxicity, url_filter
from keysieve.llm.common import documents


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(spark, documents(spark, sf_dir))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(spark, [documents(spark, sf_dir)], keep=["doc_id"])
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(spark, documents(spark, sf_dir))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, documents(spark, sf_dir), keep=["doc_id"])


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("bound")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=["doc_id"])
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark, documents(spark, sf_dir))


def op8_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = fertility.rate(spark, documents(spark, sf_dir))
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score(spark, documents(spark, sf_dir))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_substring_dedup, op2_line_dedup, op3_byte_bpe, op4_source_mixing, op5_url_filter, op6_toxicity, op7_simhash, op8_fertility, op9_context_tree, op10_nearest)
}

#: Where SQL can express the whole query; the others are tested against brute force, round trips or held-out rows.
ORACLES: dict[str, str] = {"op1_substring_dedup": oracles.SUBSTRING, "op2_line_dedup": oracles.LINES, "op4_source_mixing": oracles.MIXING, "op5_url_filter": oracles.URLS}
