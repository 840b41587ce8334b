"""Structured Streaming jobs (2.N). Each starts a query and returns it.

Sinks are written per micro-batch under the batch number, so a batch that runs again replaces its own
output: every job can be restarted from its checkpoint after losing the driver or executors. Late rows:
anything more than the watermark (10 minutes by default) behind the newest event is dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import datetime
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from tallyferry.operators import merge as merging, validation
from tallyferry.operators.history import combined_state, partial_state, state_of
from tallyferry.operators.rates import RATE_LIMITS
from tallyferry.plans.registry import EntityDef, Registry
from tallyferry.session import keep
from tallyferry.sources.files import ROW, rename
from tallyferry.sources.snapshots import PartitionedTable
from tallyferry.streaming.sources import with_event_time


# Work through what is there, then stop. For an endless run pass e.g. {"processingTime": "30 seconds"}.
AVAILABLE_NOW = {"availableNow": True}
# How far behind the newest event a row may be; later ones are dropped, as state cannot be kept for ever.
DELAY = "10 minutes"
# (span, slide) of rate windows.
MINUTE, HOUR = ("60 seconds", "10 seconds"), ("1 hour", "10 minutes")


def start(
    df: DataFrame, checkpoint: str, mode: str, each: Callable[[DataFrame, int], None], trigger: Mapping
) -> StreamingQuery:
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(**trigger)
    return writer.foreachBatch(each).start()


def to_batches(sink: str) -> Callable[[DataFrame, int], None]:
    """Write each micro-batch to its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return write


def stream_validation(df: DataFrame, entity: EntityDef, good: str, errors: str, checkpoint: str, row: str = ROW,
                      trigger: Mapping = AVAILABLE_NOW) -> StreamingQuery:
    """Valid rows to parquet, one error line per broken rule to JSON lines."""

    def write(batch: DataFrame, number: int) -> None:
        checked = batch.persist()
        try:
            valid = checked.filter("is_valid").drop(validation.ERRORS, validation.VALID)
            valid.write.mode("overwrite").parquet(f"{good}/batch={number}")
            validation.error_rows(checked).write.mode("overwrite").json(f"{errors}/batch={number}")
        finally:
            checked.unpersist()

    return start(validation.validate(df, entity, row), checkpoint, "append", write, trigger)


def stream_import(
    df: DataFrame,
    entity: EntityDef,
    table: PartitionedTable,
    sink: str,
    checkpoint: str,
    as_of: datetime,
    tenant: object = None,
    mode: str = "create",
    mappings: Mapping[str, str] | None = None,
    tables: Mapping[str, DataFrame] | None = None,
    registry: Registry | None = None,
    row: str = ROW,
    trigger: Mapping = AVAILABLE_NOW,
) -> StreamingQuery:
    """Validate arriving rows, log broken ones, merge the others into the table.

    `row` is a unique order column of the files. A batch reads and rewrites only the buckets its keys fall into. Running a
    batch again applies nothing twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        data = rename(batch, mappings or {}).withColumn(row, F.col(row).cast("long"))
        checked = keep(validation.validate(data, entity, row, aside=()), "stream-validated")
        validation.error_rows(checked).write.mode("overwrite").json(f"{sink}/errors/batch={number}")
        good = checked.filter("is_valid").drop(validation.ERRORS, validation.VALID)
        touched = table.touched(good.select(F.col(entity.match_key).alias(table.key)))

        def merged(rows: DataFrame) -> DataFrame:
            done = merging.merge(rows, good, entity, as_of, tenant, mode, None, tables, registry, f"batch-{number}", row, hold=keep)
            done.outcomes.write.mode("overwrite").parquet(f"{sink}/outcomes/batch={number}")
            return done.table

        table.change(number + 1, touched, merged)

    return start(df, checkpoint, "append", write, trigger)


def stream_rates(df: DataFrame, keys: str | Sequence[str], ts: str, sink: str, checkpoint: str, spans: Sequence[tuple[str, str]] = (MINUTE,),
                 trigger: Mapping = AVAILABLE_NOW, delay: str = DELAY) -> StreamingQuery:
    """Requests per key in sliding windows of one or several (span, slide), each window written once it is closed.

    `windows_so_far` adds the windows that are still open.
    """
    timed = with_event_time(df, ts, delay)
    keys = [keys] if isinstance(keys, str) else list(keys)
    counts = [timed.groupBy(F.window(ts, *span), *keys).agg(F.count(F.lit(1)).alias("requests")) for span in spans]
    return start(reduce(DataFrame.unionByName, counts), checkpoint, "append", to_batches(sink), trigger)


def stream_progress(df: DataFrame, ts: str, flag: str, sink: str, checkpoint: str, every: str = "5 seconds",
                    trigger: Mapping = AVAILABLE_NOW, delay: str = DELAY) -> StreamingQuery:
    """P5: at most one progress line per interval: rows seen and rows with `flag` set."""
    timed = with_event_time(df, ts, delay)
    lines = timed.groupBy(F.window(ts, every)).agg(F.count(F.lit(1)).alias("rows"), F.count_if(flag).alias("flagged"))
    return start(lines, checkpoint, "append", to_batches(sink), trigger)


def windows_so_far(spark: SparkSession, sink: str, checkpoint: str, counts: Sequence[str], operators: int = 1) -> DataFrame:
    """Every window of a stopped or idle windowed job exactly once: closed ones from the sink, open ones from its state.

    The job's state keeps a window until the watermark passes its end, and the batch that drops it from there writes it to
    the sink. Reading the state changes nothing: the job may go on from its checkpoint later. `counts` names the job's
    aggregates in order, `operators` says how many window lengths it has.
    """
    found = []
    for number in range(operators):
        state = spark.read.format("statestore").option("operatorId", number).load(checkpoint)
        # The store calls every count "count"; casting goes by position.
        held = state.schema["value"].dataType.fields
        named = T.StructType([T.StructField(name, f.dataType) for name, f in zip(counts, held, strict=True)])
        found.append(state.withColumn("value", F.col("value").cast(named)).select("key.*", "value.*"))
    opened = reduce(DataFrame.unionByName, found)
    try:
        closed = spark.read.schema(opened.schema).parquet(sink)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        closed = opened.limit(0)  # no window was closed yet
    every = closed.select(*opened.columns).unionByName(opened)
    return every.select(
        F.col("window.start").cast("timestamp_ntz").alias("start"), F.col("window.end").cast("timestamp_ntz").alias("end"),
        *[c for c in opened.columns if c != "window"],
    )


def beyond_limits(windows: DataFrame, kind: str, limits: Mapping[str, tuple[int, int]] = RATE_LIMITS) -> DataFrame:
    """Adds `over`: requests of a window beyond what its class may send per minute or per hour, whichever it spans.

    Classes without limits of their own have those of `default`.
    """
    minute, hour = (
        F.coalesce(reduce(lambda case, item: case.when(F.col(kind) == item[0], item[1][i]), limits.items(), F), F.lit(limits["default"][i]))
        for i in (0, 1)
    )
    allowed = F.when(F.col("end") - F.col("start") > F.expr("INTERVAL '60' SECOND"), hour).otherwise(minute)
    return windows.withColumn("over", F.greatest(F.col("requests") - allowed, F.lit(0)))


def late(arrived: DataFrame, windows: DataFrame, counted: str, windows_a_row: int = 1) -> int:
    """How often a row of `arrived` came too late for one of its windows: rows times windows, less what was counted."""
    return arrived.count() * windows_a_row - (windows.agg(F.sum(counted)).head()[0] or 0)


def stream_dedup(df: DataFrame, key: str, ts: str, sink: str, checkpoint: str,
                 trigger: Mapping = AVAILABLE_NOW, delay: str = DELAY) -> StreamingQuery:
    """Each message once, however often it is delivered within the watermark. `late_rows` counts those dropped as late."""
    once = with_event_time(df, ts, delay).dropDuplicatesWithinWatermark([key])
    return start(once.withColumn(ts, F.col(ts).cast("timestamp_ntz")), checkpoint, "append", to_batches(sink), trigger)


def late_rows(query: StreamingQuery) -> int:
    """Rows that `stream_dedup` dropped as late in this run, over the batches whose progress Spark still holds (100)."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def stream_latest_state(log: DataFrame, order: list[str], sink: str, checkpoint: str,
                        trigger: Mapping = AVAILABLE_NOW, epoch: int = 100) -> StreamingQuery:
    """The newest state of every run, without streaming state.

    Each micro-batch is folded on its own and written; every `epoch` batches those folders and the last whole state are
    combined into a new whole state. So memory holds one batch, and a reader at most `epoch` folders and one whole state.
    """
    empty = partial_state(log.sparkSession.createDataFrame([], log.schema), order).schema

    def write(batch: DataFrame, number: int) -> None:
        partial_state(batch, order).write.mode("overwrite").parquet(f"{sink}/parts/epoch={number // epoch}/batch={number}")
        if number % epoch == epoch - 1:
            compact_state(log.sparkSession, sink, empty, number // epoch)

    return start(log, checkpoint, "append", write, trigger)


def _parts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path).select(*schema.names)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def compact_state(spark: SparkSession, sink: str, schema: T.StructType, epoch: int) -> None:
    """Whole state up to an epoch = that up to the one before + the epoch's batches. Running it again writes the same.

    What is older than the epoch before is emptied; that one stays for readers that have begun.
    """
    before = _parts(spark, f"{sink}/whole/epoch={epoch - 1}", schema)
    own = _parts(spark, f"{sink}/parts/epoch={epoch}", schema)
    combined_state(before.unionByName(own)).write.mode("overwrite").parquet(f"{sink}/whole/epoch={epoch}")
    for old in (f"{sink}/whole/epoch={epoch - 2}", f"{sink}/parts/epoch={epoch - 1}"):
        if epoch > 1:
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(old)


def read_latest_state(spark: SparkSession, sink: str, log: DataFrame, order: list[str], epoch: int) -> DataFrame:
    """The newest state of each run, as of an epoch: the whole state before it and the epoch's batches so far.

    Once the epoch is compacted, that is one folder and nothing is combined any more.
    """
    schema = partial_state(spark.createDataFrame([], log.schema), order).schema
    whole = _parts(spark, f"{sink}/whole/epoch={epoch}", schema)
    if not whole.isEmpty():
        return state_of(whole)
    before = _parts(spark, f"{sink}/whole/epoch={epoch - 1}", schema)
    return state_of(combined_state(before.unionByName(_parts(spark, f"{sink}/parts/epoch={epoch}", schema))))
