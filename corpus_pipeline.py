"""From raw documents to packed training sequences, one stage after the other.

Each stage reads what the one before kept, calls one operator of ``agroseries.llm`` and lets its
decision take effect. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agroseries.llm import language, pii, quality, queries, simhash
from agroseries.sources.shared import saved

LEAST_SCORE = 0.4


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter whose language has at least ``LEAST_SCORE`` of the text."""
    found = queries.predicted(docs)
    known = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return found.where(known).select(docs.columns)


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are near the profile of some language."""
    return quality.judge(docs, "text", "lang").where("kept").select(docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate component: the one with the smallest id."""
    found = simhash.near_duplicates(docs, "doc_id", "text", shingle=3, distance=3)
    return found.where("keeper").select(docs.columns)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every span of personal data replaced by its kind, and their new length."""
    found = pii.find(docs, "text")
    cleaned = found.withColumn("text", F.when(F.size("spans") > 0, pii.redact(F.col("text"), F.col("spans"))).otherwise(F.col("text")))
    return cleaned.withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences of 4096 tokens."""
    return queries.pieces_of(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", keep_known_language),
    ("quality", keep_good_quality),
    ("near_duplicates", keep_one_of_each_group),
    ("personal_data", remove_personal_data),
    ("packing", pack_sequences),
]

#: Recurrent labels, XXH64 fingerprints and tokenizer ids have no SQL; tests hold the stages against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage kept is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
