"""Trailing request counts per key."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyferry.operators import numbering
from tallyferry.session import keep

# Requests allowed per minute and per hour, by class of request.
RATE_LIMITS = {
    "default": (60, 1000),
    "export": (30, 500),
    "import": (20, 200),
    "upload": (10, 100),
}


# Requests of a key in one slot of time that one task may take.
HOT_ROWS = 1_000_000


def trailing_counts(
    df: DataFrame, key: str, ts: str, seconds: Sequence[int], hot_rows: int = HOT_ROWS, hold: Callable[[DataFrame], DataFrame] = keep
) -> DataFrame:
    """Adds `last_<s>s` for each span: earlier requests of the key in (ts - s, ts], itself excluded.

    Keys with more than `hot_rows` requests in a slot of time go by range partitions (`_by_ranges`), whatever their rates;
    one pass over keys and times looks for them first. All others take one shuffle (`_by_slots`).
    """
    slot = F.floor(_micros(ts) / F.lit(_slot_width(seconds)))
    busy = df.filter(F.col(ts).isNotNull()).groupBy(F.col(f"`{key}`").alias("__hot"), slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    # Each of these keys has more than hot_rows requests, so there are fewer than rows / hot_rows of them.
    hot = hold(busy.filter(F.col("n") > hot_rows).select("__hot").distinct())
    if hot.isEmpty():
        return _by_slots(df, key, ts, seconds)
    is_hot = F.col(f"`{key}`").eqNullSafe(F.col("__hot")) & F.col(ts).isNotNull()
    return _by_slots(df.join(hot, is_hot, "left_anti"), key, ts, seconds).unionByName(
        _by_ranges(df.join(hot, is_hot, "left_semi"), key, ts, seconds, hold)
    )


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _slot_width(seconds: Sequence[int]) -> int:
    return 4 * max(seconds) * 1_000_000


def _by_ranges(df: DataFrame, key: str, ts: str, seconds: Sequence[int], hold: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Requests so far at a time, less those so far at the start of the span before it.

    Both numbers are read off one running count over (key, time), which is dealt into range partitions of even size, so a
    key may be spread over as many tasks as it needs. Only key, time and a number of the request are dealt out; the
    requests meet their counts by that number.
    """
    rows = hold(df.withColumn("__id", F.monotonically_increasing_id()))
    # kind 0 counts a request, kind 1 reads the count after all requests of the same time
    reads = [F.struct(F.col("__at").alias("at"), F.lit(1).alias("kind"), F.lit(0).alias("one"), F.lit(-1).alias("span"))]
    reads += [
        F.struct((F.col("__at") - F.lit(s * 1_000_000)).alias("at"), F.lit(1).alias("kind"), F.lit(0).alias("one"), F.lit(i).alias("span"))
        for i, s in enumerate(seconds)
    ]
    counted = F.struct(F.col("__at").alias("at"), F.lit(0).alias("kind"), F.lit(1).alias("one"), F.lit(-2).alias("span"))
    steps = rows.select(F.col(f"`{key}`").alias("k"), "__id", _micros(ts).alias("__at")).select(
        "k", "__id", F.explode(F.array(counted, *reads)).alias("s")
    ).select("k", "s.at", "s.kind", "__id", "s.span", "s.one")
    order = ["k", "at", "kind", "__id", "span"]
    parts = numbering.carried(numbering.ordered(steps, order, hold), {"__before": F.sum("one")})
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = parts.withColumn("seen", F.sum("one").over(inside) + F.col("__before")).filter("kind = 1")
    at = {i: F.max(F.when(F.col("span") == i, F.col("seen"))) for i in range(-1, len(seconds))}
    counts = seen.groupBy("__id").agg(*[(at[-1] - at[i] - 1).alias(f"last_{s}s") for i, s in enumerate(seconds)])
    return rows.join(counts, "__id").drop("__id")


def _by_slots(df: DataFrame, key: str, ts: str, seconds: Sequence[int]) -> DataFrame:
    """Time is cut into slots at least as long as the longest span, and the work is partitioned by (key, slot).

    Each request is +1 at its time and -1 when it leaves a span; a request still counted when its slot ends is repeated as
    a marker in the next slot. The answer is a running sum, so the cost does not grow with the number of requests inside a
    span.
    """
    names = [f"last_{s}s" for s in seconds]
    width = _slot_width(seconds)
    spans = [s * 1_000_000 for s in seconds]
    at = _micros(ts)
    slot = F.floor(at / F.lit(width)).cast("long")

    def step(when: Column, deltas: list[Column | int], real: bool) -> Column:
        return F.struct(
            when.alias("at"),
            *[(F.lit(d) if isinstance(d, int) else d).cast("long").alias(n) for d, n in zip(deltas, names)],
            F.lit(real).alias("real"),
        )

    def only(i: int, value: int) -> list[Column | int]:
        return [value if j == i else 0 for j in range(len(spans))]

    def in_slot(when: Column, number: Column) -> Column:
        return (F.floor(when / F.lit(width)).cast("long")) == number

    here = [step(F.col("__at"), [1] * len(spans), True)]
    there = []
    for i, span in enumerate(spans):
        gone = F.col("__at") + F.lit(span)
        here.append(F.when(in_slot(gone, F.col("__slot")), step(gone, only(i, -1), False)))
        crosses = in_slot(gone, F.col("__slot") + 1)
        there.append(F.when(crosses, step(F.col("__at"), only(i, 1), False)))
        there.append(F.when(crosses, step(gone, only(i, -1), False)))
    places = F.array(
        F.struct(F.col("__slot").alias("slot"), F.array_compact(F.array(*here)).alias("steps")),
        F.struct((F.col("__slot") + 1).alias("slot"), F.array_compact(F.array(*there)).alias("steps")),
    )
    columns = [F.col(f"`{c}`") for c in df.columns]
    steps = (
        df.withColumn("__at", at)
        .withColumn("__slot", slot)
        .withColumn("__place", F.explode(places))
        .withColumn("__step", F.explode("__place.steps"))
        .select(
            F.col(f"`{key}`").alias("__key"),
            F.col("__place.slot").alias("__slot"),
            F.col("__step.at").alias("__at"),
            *[F.col(f"__step.{n}").alias(f"__{n}") for n in names],
            F.col("__step.real").alias("__real"),
            # Markers carry no payload through the shuffle.
            F.when(F.col("__step.real"), F.struct(*columns)).alias("__row"),
        )
    )
    running = Window.partitionBy("__key", "__slot").orderBy("__at").rangeBetween(Window.unboundedPreceding, 0)
    return (
        steps.withColumns({n: F.sum(f"__{n}").over(running) - 1 for n in names})
        .filter("__real")
        .select("__row.*", *names)
    )


def over_limit(counts: DataFrame, limits: tuple[int, int], minute: str = "last_60s", hour: str = "last_3600s") -> DataFrame:
    """Requests that a class with these per-minute and per-hour limits would refuse."""
    return counts.filter((F.col(minute) >= limits[0]) | (F.col(hour) >= limits[1]))
