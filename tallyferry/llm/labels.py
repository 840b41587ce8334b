"""Which labelled rows a classifier may learn from, as a bounded table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LABELLED = 200_000
FOLDS = 5


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5; rows of fold 0 are held out, and so are rows without an id."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(FOLDS)).cast("int"), F.lit(0))


def learnable(labels: DataFrame, target: str) -> DataFrame:
    """doc_id, label, fold of all labelled rows that are not held out.

    An id labelled several times counts as 1 if one of its labels is.
    """
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1) & (fold(F.col("doc_id")) != 0))
        .groupBy("doc_id").agg(F.max(target).cast("int").alias("label"))
        .withColumn("fold", fold(F.col("doc_id")))
    )


def to_learn_from(labels: DataFrame, target: str, most: int = MAX_LABELLED) -> DataFrame:
    """At most `most` rows of `learnable`, those with the least hashes of ids.

    This bound is the only sample in the classifiers; it makes the table small enough to broadcast (at most 32 bytes a
    row).
    """
    return learnable(labels, target).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
