"""A corpus pipeline: stages over documents, each written and read again by the next.

Rejects documents of low quality, leaves one of each group of near copies, masks personal data, thins
sources, languages and topics to their target weights and packs the rest into training sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.llm import mixing, ngram_join, packing, pii, quality
from tracklake.session import work_path


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least the threshold; labels of the held-out fold are not learned from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.with_quality(docs, labels, score="_quality")
    return scored.filter(F.col("_quality") >= quality.THRESHOLD).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five words, similarity 0.8) the one with the smallest id; rows without id stay."""
    return ngram_join.first_of_groups(docs, size=5, percent=80)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask_personal_data(docs, n_chars="n_chars" if "n_chars" in docs.columns else None)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Thins what lies above its target weight; what lies below is kept whole."""
    return mixing.with_mixture(docs, keep=1.0).filter("_kept").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences, with their ids."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", reject_low_quality),
    ("ngram_jaccard_join", one_of_each_group),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: The stages train models and tokenize, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = work_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
