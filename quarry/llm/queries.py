"""The registered queries of the training-data operators: thin forms over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.lexical import LEXICAL_SQL, lexical_search
from quarry.llm.licenses import license_scan, license_sql
from quarry.llm.lines import LINE_DEDUP_SQL, line_dedup
from quarry.llm.mixing import document_rates
from quarry.llm.oracles import REPEATED_BYTES_SQL, REPEATED_WORDS_SQL, repetition_sql
from quarry.llm.packing import pack_buckets, packing_sql
from quarry.llm.repetition import repetition_quality
from quarry.llm.resampling import RESAMPLE_SQL, importance_resample
from quarry.llm.shards import feistel_shards
from quarry.llm.simhash import simhash_components
from quarry.llm.substrings import remove_repeated_words
from quarry.llm.suffixes import remove_repeated_bytes
from quarry.llm.topk import TOP_K_SQL, exact_top_k
from quarry.llm.toxicity import toxicity_scores


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash_vp_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_documents(spark, sf_dir)).drop("text_key", "first")


#: Target shares of tokens by quality label.
QUALITY_WEIGHTS = {0: 0.03, 1: 0.97}


def op2_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return document_rates(_documents(spark, sf_dir), labels, QUALITY_WEIGHTS)


def op3_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_words(_documents(spark, sf_dir))


def op4_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_quality(_documents(spark, sf_dir))


def op5_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(_documents(spark, sf_dir))


def op6_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel_shards(_documents(spark, sf_dir)).drop("row_no")


def op7_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_documents(spark, sf_dir)).select(
        "row.doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


def op9_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_buckets(_documents(spark, sf_dir))


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def op11_crc_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(_documents(spark, sf_dir), _benchmark(spark, sf_dir))


def op12_max_score_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(_documents(spark, sf_dir), _benchmark(spark, sf_dir))


def op13_template_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_simhash_vp_tree,
        op2_soft_mixing,
        op3_recompression,
        op4_repetition_coverage,
        op5_prefix_doubling,
        op6_feistel_shards,
        op7_toxicity_cnn,
        op8_line_dedup,
        op9_bit_sliced_top_k,
        op10_length_buckets,
        op11_crc_resampling,
        op12_max_score_search,
        op13_template_licenses,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_recompression": REPEATED_WORDS_SQL,
        "op4_repetition_coverage": repetition_sql(),
        "op5_prefix_doubling": REPEATED_BYTES_SQL,
        "op8_line_dedup": LINE_DEDUP_SQL,
        "op9_bit_sliced_top_k": TOP_K_SQL,
        "op10_length_buckets": packing_sql(),
        "op11_crc_resampling": RESAMPLE_SQL,
        "op12_max_score_search": LEXICAL_SQL,
        "op13_template_licenses": license_sql(),
    }
