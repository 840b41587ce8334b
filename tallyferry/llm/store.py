"""Intermediate tables in the folder all executors share, and map-side reduction by a bounded bitmap."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where this process found it; elsewhere it must be installed or shipped."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under `spark.checkpoint.dir`; only a local session without that setting gets its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is shuffled by a query that is made and run in here is removed once the query has ended."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows of `df`, written once to the shared folder: lineage ends there, and lost executors cost no rows.

    What was shuffled for them is removed once they are written, as nothing reads it again.
    """
    spark = df.sparkSession
    path = shared_path(spark, purpose)
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def marked(rows: DataFrame, name: str, key: Column, wanted: DataFrame, log2_bits: int = 22) -> DataFrame:
    """`rows` with a boolean column: whether the row's key, a hash, may be among those of `wanted`'s only column.

    The wanted keys become a bitmap of 2**log2_bits bits, a table of at most 2**log2_bits / 64 rows whatever the input,
    so its broadcast has a proven bound (16 bytes a row: 1 MB at 22). False is certain; where it is true, keys may only
    share a bit, and the caller decides exactly. Nothing is shuffled but the bitmap.
    """
    bits = 1 << log2_bits
    slot = F.pmod(F.col(wanted.columns[0]), F.lit(bits))
    words = (
        wanted.select(slot.alias("_slot"))
        .groupBy(F.shiftright("_slot", 6).alias("_word"))
        .agg(F.expr("bit_or(shiftleft(1L, CAST(_slot & 63 AS INT)))").alias("_bits"))
    )
    return (
        rows.withColumn("_slot", F.pmod(key, F.lit(bits)))
        .withColumn("_word", F.shiftright("_slot", 6))
        .join(F.broadcast(words), "_word", "left")
        .withColumn(name, F.expr("coalesce(getbit(_bits, CAST(_slot & 63 AS INT)) = 1, false)"))
        .drop("_slot", "_word", "_bits")
    )


def wanted_only(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows whose key may be among `wanted[key]`, decided before any shuffle; the caller joins exactly afterwards."""
    return marked(rows, "_may", F.xxhash64(key), wanted.where(F.col(key).isNotNull()).select(F.xxhash64(key))).where("_may").drop("_may")


def without(rows: DataFrame, key: str, dropped: DataFrame) -> DataFrame:
    """Rows whose key is not among `dropped[key]`; only those that may be are shuffled. Null keys stay."""
    seen = marked(rows, "_may", F.xxhash64(key), dropped.where(F.col(key).isNotNull()).select(F.xxhash64(key)))
    maybe = seen.where("_may").drop("_may").join(dropped.select(key).distinct(), key, "left_anti")
    return seen.where("NOT _may").drop("_may").select(*rows.columns).unionByName(maybe.select(*rows.columns))
