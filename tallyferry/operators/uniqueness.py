"""A value that at most one row of a table may hold, kept so by changes in file order.

A claim (a change that gives a row a value) is refused if, when it comes, another row holds the value. Whether one does
depends on which earlier claims were refused, so claims are judged in rounds: each round takes the judgement of the round
before, finds what every row holds at every time, and judges all claims anew. A claim whose earlier ones are judged right is
judged right itself, so each round settles at least the next claim and the rounds end when nothing changes: after one round
where no value is claimed twice, after two or three where claims only compete, after more where refusals follow from
refusals. Both scans of a round are segmented, so neither a hot row nor a hot value is one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyferry.operators import numbering
from tallyferry.session import keep

CHUNK = 1_000_000


def refused_claims(events: DataFrame, size: int = CHUNK) -> DataFrame:
    """`at` of the refused claims among `events`: at (long, unique and from 1; 0 for what was there before), who, value, claims.

    An event says that `who` holds `value` from then on, or nothing where it is null. Events that are no claims always hold.
    Rows at 0 may share a value; a claim is refused while any of them holds it.
    """
    now = keep(events.select("at", "who", "value", "claims", F.lit(True).alias("accepted")), "claims")
    while True:
        signal = F.when(F.col("accepted"), F.struct(F.col("value")))
        states = numbering.in_chunks(now.withColumn("signal", signal), "who", "at", size)
        # what a row held before each of its events
        held = numbering.last_before(states, "who", "at", "signal", "before").withColumn("before", F.col("before")["value"])
        changes = F.col("accepted") & ~F.col("before").eqNullSafe(F.col("value"))
        steps = held.select(
            "at", "who", "claims", "accepted", "value",
            F.explode(F.array_compact(F.array(
                F.when(F.col("claims") & F.col("value").isNotNull(), _step("value", 0, 0, F.col("before").eqNullSafe(F.col("value")))),
                F.when(changes & F.col("value").isNotNull(), _step("value", 1, 1)),
                F.when(changes & F.col("before").isNotNull(), _step("before", 2, -1)),
            ))).alias("step"),
        ).select("at", "who", "claims", "accepted", "step.*")
        # What was there before shares its time, so `who` is part of the order of a value's steps.
        order = F.struct("at", "kind", "who")
        counted = numbering.sum_before(numbering.in_chunks(steps.withColumn("order", order), "of", "order", size), "of", "order", "delta", "holders")
        judged = counted.where("kind = 0").select("at", (F.col("holders") - F.col("own").cast("int") <= 0).alias("fine"), "accepted")
        judged = keep(judged, "judged")
        if judged.where("fine <> accepted").isEmpty():
            return judged.where("NOT fine").select("at")
        now = keep(
            now.join(judged.select("at", "fine"), "at", "left").select(
                "at", "who", "value", "claims", F.when(F.col("claims"), F.coalesce("fine", "accepted")).otherwise(F.col("accepted")).alias("accepted")
            ),
            "claims",
        )


def _step(of: str, kind: int, delta: int, own=None):
    return F.struct(
        F.col(of).alias("of"), F.lit(kind).alias("kind"), F.lit(delta).alias("delta"), (F.lit(False) if own is None else own).alias("own")
    )
