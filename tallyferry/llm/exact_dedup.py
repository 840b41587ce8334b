"""Exact deduplication by progressive refinement, in DataFrame functions only.

Length first, then the hash of a prefix, then the hash of the whole text, which is computed only for rows whose
length and prefix may be those of another row: the shared ones travel as a bitmap of bounded size, so this is decided
where the row is read. Only lengths, hashes and ids are shuffled; of whole rows, those alone that may have a copy. The
group tables come from aggregates with partial sums, so a group of any size costs each task one row.

Null counts as empty. Rows of the smallest id of a group stay, all of them if that id is repeated. A null id is never
the smallest unless the group has no other. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyferry.llm.store import marked, stored

PREFIX_CHARS = 64


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _hashed(docs: DataFrame, text_col: str, prefix_chars: int) -> DataFrame:
    """_row (the columns of `docs`), _full: the hash of the whole text where another row may equal it, else null."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), normalised(F.col(f"`{text_col}`")).alias("_text")).select(
        "_row", "_text", F.length("_text").alias("_len"), F.xxhash64(F.substring("_text", 1, prefix_chars)).alias("_prefix")
    )
    light = stored(rows.select("_len", "_prefix"), "lengths")
    lengths = light.groupBy("_len").agg(F.count("*").alias("_n")).where("_n > 1").select("_len")
    prefixes = (
        light.join(lengths, "_len", "left_semi")
        .groupBy("_len", "_prefix").agg(F.count("*").alias("_n")).where("_n > 1")
        .select(F.xxhash64("_len", "_prefix"))
    )
    key = F.xxhash64("_len", "_prefix")
    return marked(rows, "_shared", key, prefixes).select(
        "_row", F.when(F.col("_shared"), F.sha2("_text", 256)).alias("_full"), key.alias("_spread")
    )


def _groups(hashed: DataFrame, id_col: str) -> DataFrame:
    return (
        hashed.where(F.col("_full").isNotNull())
        .groupBy("_full").agg(F.min(F.col(f"_row.`{id_col}`")).alias("_keep_id"), F.count("*").alias("_group_size"))
        .where("_group_size > 1")
    )


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row per document: _row (the columns of `docs`), _keep_id, _group_size and _kept.

    Take from _row what is needed: what is not is never shuffled.
    """
    hashed = _hashed(docs, text_col, prefix_chars)
    groups = _groups(hashed, id_col).withColumnRenamed("_full", "_key")
    keyed = hashed.withColumn("_key", F.coalesce("_full", F.hex("_spread")))  # no row waits at a null key
    own = F.col(f"_row.`{id_col}`")
    return keyed.join(groups, "_key", "left").select(
        "_row",
        F.when(F.col("_group_size").isNull(), own).otherwise(F.col("_keep_id")).alias("_keep_id"),
        F.coalesce("_group_size", F.lit(1)).cast("long").alias("_group_size"),
        (F.col("_group_size").isNull() | own.eqNullSafe(F.col("_keep_id"))).alias("_kept"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """The documents that stay, with their own columns; rows that have no copy stay where they are read."""
    hashed = _hashed(docs, text_col, prefix_chars)
    groups = _groups(hashed, id_col)
    maybe = hashed.where(F.col("_full").isNotNull()).join(groups, "_full", "left").where(
        F.col("_group_size").isNull() | F.col(f"_row.`{id_col}`").eqNullSafe(F.col("_keep_id"))
    )
    return hashed.where(F.col("_full").isNull()).select("_row.*").union(maybe.select("_row.*"))
