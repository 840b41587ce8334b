"""A corpus cleaned in five stages, each on all that its predecessor kept; every stage is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyferry.llm import decontamination, jaccard_join, piece_sampling, queries
from tallyferry.llm import exact_dedup as exact
from tallyferry.llm import toxicity as toxic
from tallyferry.llm.store import importable, stored


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models give less than their threshold."""
    return toxic.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id."""
    return exact.exact_dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by word shingles the document with the smallest id."""
    return jaccard_join.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item stands."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its sampled pieces, from which the text can be decoded."""
    return piece_sampling.sampled_pieces(docs, queries.vocabulary(piece_sampling.MODEL)).withColumnsRenamed(
        {"_pieces": "pieces", "_n_pieces": "n_pieces", "_pieces_sha256": "pieces_sha256", "_lossless": "lossless"}
    )


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("SentencePiece encoding and decoding", pieces),
]

#: The stages use trained models, a closure over similarities and a sampler, which SQL cannot state; tests compare them
#: with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
