"""The corpus pipeline: toxicity, near duplicates, mixing, packing, each stage on all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmark.llm import length_buckets, ngram_join, pfair_mix, toxicity
from quillmark.llm.common import WRITTEN, stored, swept


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that of the smallest doc_id."""
    return ngram_join.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in mixed order: files, and rows in them, follow the schedule."""
    return pfair_mix.mixed(docs)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's bucket, batch and place; batches take documents in mixed order."""
    return length_buckets.pack_in_order(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_batches),
]

#: SQL can't train the toxicity model; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = len(WRITTEN)
    for _, stage in STAGES:
        docs, path = stored(stage(spark, docs, sf_dir))
        swept(spark, since, path)  # what a stage has read and written on its way is done with
    return docs
