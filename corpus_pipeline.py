"""From raw documents to packed batches: five stages of training-data operators, each over all that the last one kept.

Defined results: rows with null or blank texts pass every stage and are packed with no tokens (of equal ones SimHash keeps
one); repeated rows are scored alike, count as one document for line dedup and SimHash and are repeated alike; extra
columns pass through up to packing; a document that loses its last line with a word to line dedup goes; empty tables give
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import WORD, saved
from quarry.llm.lines import line_dedup
from quarry.llm.mixing import mix_documents
from quarry.llm.packing import pack_buckets
from quarry.llm.simhash import simhash_dedup
from quarry.llm.toxicity import drop_toxic

#: Shares of tokens by quality label that the mixing stage aims at. With a floor of one no document is lost to it, and
#: with a ceiling of two at most one more copy of a document is made, even where that leaves a target unreached.
WEIGHTS, FLOOR, CEILING = {0: 0.1, 1: 0.9}, 1.0, 2.0


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return drop_toxic(docs, _labels(spark, sf_dir))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line go, and documents that lose all lines with words; n_chars follows the kept text."""
    worded = lambda c: F.coalesce(F.col(c).rlike(WORD), F.lit(False))
    found = line_dedup(docs).where(worded("text") | ~worded("row.text"))
    changed = {"text": F.col("text"), "n_chars": F.coalesce(F.length("text"), F.lit(0)).cast("long")}
    return found.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash_dedup(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat so that expected tokens come as near to the target shares as floor and ceiling allow."""
    return mix_documents(docs, _labels(spark, sf_dir), WEIGHTS, floor=FLOOR, ceiling=CEILING)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets a place in a batch of its length bucket."""
    return pack_buckets(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", lines),
    ("simhash", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

#: A trained classifier decides the first stage, so SQL can't express the result; tests/llm/test_pipeline.py holds each
#: stage against brute force on the stage's own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
