"""Row numbers, batch ids and running totals over range partitions.

Rows are dealt into range partitions of their order, sorted there and written once with their place. One count or one
set of sums per range partition is brought to the driver (as many lines as the session has shuffle partitions, whatever
the rows), summed up and handed back. So any key will do, sparse, hashed or text, and no task holds more than its range.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyferry.session import keep

# monotonically_increasing_id() has the partition in the upper bits and the row's place in the lower 33.
_PLACE_BITS = 33
Hold = Callable[[DataFrame], DataFrame]


def batch_id(row: Column, size: int) -> Column:
    """0-based batch of a 1-based row number."""
    return F.floor((row - 1) / F.lit(size)).cast("long")


def ordered(df: DataFrame, order: Sequence[str | Column], hold: Hold = keep) -> DataFrame:
    """Adds `__part` (range partition by `order`, ascending where it does not say otherwise) and `__place` (from 0 inside it).

    `order` should be unique: rows that agree in it share a partition and have no defined places among them. `hold` writes
    the rows down, so that every later pass sees the same partitions.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__spot", F.monotonically_increasing_id())
    return hold(placed).select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.shiftright("__spot", _PLACE_BITS).cast("int").alias("__part"),
        F.col("__spot").bitwiseAND((1 << _PLACE_BITS) - 1).alias("__place"),
    )


def carried(rows: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Adds, for each named sum, its total over all earlier range partitions (0 before the first)."""
    found = rows.groupBy("__part").agg(*[value.alias(name) for name, value in sums.items()])
    parts = sorted(found.collect(), key=lambda r: r["__part"])
    before = []
    for name in sums:
        given = [r[name] for r in parts if r[name] is not None]
        zero = type(given[0])(0) if given else 0
        before.append(list(accumulate((r[name] or zero for r in parts), initial=zero)))
    lines = [(r["__part"], *[column[i] for column in before]) for i, r in enumerate(parts)]
    # One short line per range partition: the broadcast is bounded by the session's shuffle partitions.
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(lines, found.schema)), "__part")


def number_by_key(df: DataFrame, key: str | Sequence[str], row: str = "row", hold: Hold = keep) -> DataFrame:
    """A10 for a table: 1-based row number by one or several columns that are unique together; nulls come first.

    One shuffle of the rows. A row's number depends on data alone, not on how the input was split.
    """
    rows = carried(ordered(df, [key] if isinstance(key, str) else list(key), hold), {"__before": F.count(F.lit(1))})
    return rows.select(
        (F.col("__before") + F.col("__place") + 1).alias(row), *[F.col(f"`{c}`") for c in df.columns]
    )


def running_totals(df: DataFrame, order: str, values: Sequence[str], hold: Hold = keep) -> DataFrame:
    """Running sum of `values` by a unique column `order` of any type. Adds `running_<value>` columns."""
    rows = carried(ordered(df, [order], hold), {f"__c_{v}": F.sum(v) for v in values})
    inside = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[(F.coalesce(F.sum(v).over(inside), F.lit(0)) + F.col(f"__c_{v}")).alias(f"running_{v}") for v in values],
    )


def running_progress(
    rows: DataFrame, row: str, size: int, flags: dict[str, Column] | None = None, hold: Hold = keep
) -> DataFrame:
    """Per batch, the rows and outcome counts so far.

    Rows are first reduced to one line per batch (with map-side partial sums).
    """
    flags = flags or {}
    per_batch = rows.groupBy(batch_id(F.col(row), size).alias("batch")).agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in flags.items()]
    )
    return running_totals(per_batch, "batch", ["rows", *flags], hold)


def in_chunks(df: DataFrame, key: str, order: str, size: int, hold: Hold = keep) -> DataFrame:
    """Adds `__chunk`: the rows of a key in runs of `size` by their rank in `order`, however far apart their values are."""
    numbered = number_by_key(df, [key, order], "__at", hold)
    starts = numbered.groupBy(key).agg(F.min("__at").alias("__first"))
    chunk = F.floor((F.col("__at") - F.col("__first")) / F.lit(size)).cast("long")
    return numbered.join(starts, key).withColumn("__chunk", chunk).drop("__at", "__first")


def _carried_on(chunks: DataFrame, key: str, order: str, inside: Column, end: Column, over_chunks: Column) -> DataFrame:
    """A segmented scan: `__inside` over a row's chunk so far, `__carry` over the earlier chunks of its key."""
    # One line per chunk, joined back by (key, chunk), of which neither has more rows than a chunk.
    ends = chunks.groupBy(key, "__chunk").agg(end.alias("__end"))
    carry = ends.select(key, "__chunk", over_chunks.alias("__carry"))
    return chunks.withColumn("__inside", inside).join(carry, [key, "__chunk"])


def last_before(chunks: DataFrame, key: str, order: str, signal: str, name: str) -> DataFrame:
    """Adds `name`: the last signal that is not null among the earlier rows of a key; rows come from `in_chunks`."""
    rows = Window.partitionBy(key, "__chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    parts = Window.partitionBy(key).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    end = F.max_by(signal, F.when(F.col(signal).isNotNull(), F.col(order)))
    scanned = _carried_on(chunks, key, order, F.last(signal, ignorenulls=True).over(rows), end, F.last("__end", ignorenulls=True).over(parts))
    return scanned.withColumn(name, F.coalesce("__inside", "__carry")).drop("__inside", "__carry", "__chunk")


def sum_before(chunks: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    """Adds `name`: the sum of `value` over the earlier rows of a key; rows come from `in_chunks`."""
    rows = Window.partitionBy(key, "__chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    parts = Window.partitionBy(key).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    scanned = _carried_on(chunks, key, order, F.sum(value).over(rows), F.sum(value), F.sum("__end").over(parts))
    total = F.coalesce("__inside", F.lit(0)) + F.coalesce("__carry", F.lit(0))
    return scanned.withColumn(name, total).drop("__inside", "__carry", "__chunk")
