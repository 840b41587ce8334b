"""Job and run history (2.M, E8, E9, F5-F8, D25-D28).

Jobs: job_id, client_id, name, job_type, export_config, import_config (JSON text), cron_schedule, enabled,
created_at. Runs: run_id, job_id, status, started_at, completed_at, error_message, result_metadata (JSON
text), created_at. "Latest per key" is always an aggregate, never a sort of a key's rows: partial maxima
are taken before the shuffle, so a job with a third of all runs is no bottleneck.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from tallyferry.functions.dates import as_ntz, run_duration
from tallyferry.operators.paging import page_number, page_totals, sort_columns

# The counts an import run reports.
RESULT_COUNTS = ("imported_count", "updated_count", "deleted_count", "skipped_count", "failed_count")


def created_between(df: DataFrame, start: datetime | None, end: datetime | None, column: str = "created_at") -> DataFrame:
    """Both ends optional and inclusive; aware times move to naive UTC. Pushes down to the scan."""
    if start is not None:
        df = df.filter(F.col(column) >= as_ntz(start))
    if end is not None:
        df = df.filter(F.col(column) <= as_ntz(end))
    return df


def config_entity_is(entity: str) -> Column:
    """The entity named in either config."""
    return (F.get_json_object("export_config", "$.entity") == entity) | (
        F.get_json_object("import_config", "$.entity") == entity
    )


def scheduled_jobs(jobs: DataFrame) -> DataFrame:
    """D28."""
    return jobs.filter(F.col("enabled") & F.col("cron_schedule").isNotNull())


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    totals: DataFrame


def list_jobs(
    jobs: DataFrame,
    tenant: object,
    start: datetime | None = None,
    end: datetime | None = None,
    job_type: str | None = None,
    entity: str | None = None,
    page: int = 1,
    page_size: int = 50,
) -> Page:
    """Filtered, newest first, one page, with totals."""
    found = created_between(jobs.filter(F.col("client_id") == F.lit(tenant)), start, end)
    if job_type is not None:
        found = found.filter(F.col("job_type") == job_type)
    if entity is not None:
        found = found.filter(config_entity_is(entity))
    newest = sort_columns([("created_at", "desc")], ["job_id"])
    return Page(page_number(found, newest, page, page_size), page_totals(found, page_size))


def list_runs(runs: DataFrame, job_id: object, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Runs of one job, newest first."""
    mine = created_between(runs.filter(F.col("job_id") == F.lit(job_id)), start, end)
    return mine.orderBy(*sort_columns([("created_at", "desc")], ["run_id"]))


def latest(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """For each key the row with the greatest `order` values."""
    newest = F.max_by(F.struct(*columns), F.struct(*order))
    return df.groupBy(key).agg(newest.alias("__newest")).select(key, "__newest.*")


def jobs_with_last_run(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Every job with a struct `last_run`, null when it never ran."""
    columns = ["run_id", "status", "started_at", "completed_at", "error_message"]
    newest = runs.groupBy("job_id").agg(
        F.max_by(F.struct(*columns), F.struct("created_at", "run_id")).alias("last_run")
    )
    return jobs.join(newest, "job_id", "left")


def run_summary(runs: DataFrame) -> DataFrame:
    """Duration in whole seconds and the outcome counts of each run; counts of open runs are null."""
    done = F.col("status").isin("succeeded", "failed")
    counts = [
        F.when(done, F.coalesce(F.get_json_object("result_metadata", f"$.{c}").try_cast("long"), F.lit(0))).alias(c)
        for c in RESULT_COUNTS
    ]
    return runs.select(
        "run_id", "job_id", "status", run_duration(F.col("started_at"), F.col("completed_at")).alias("seconds"), *counts
    )


def job_counts(jobs: DataFrame) -> DataFrame:
    """Total, export and import jobs."""
    return jobs.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("job_type") == "export").alias("exports"),
        F.count_if(F.col("job_type") == "import").alias("imports"),
    )


# Fields of a run's state; the first is set by every event, the others by events that give them.
STATE_FIELDS = ("status", "started_at", "completed_at", "error_message", "result_metadata")


def fold_status(log: DataFrame, order: list[str]) -> DataFrame:
    """The state of each run after all its status events. A field is set only by events that give it.

    `log`: run_id, status, started_at, completed_at, error_message, result_metadata, plus `order` columns.
    """
    return state_of(partial_state(log, order))


def partial_state(log: DataFrame, order: list[str]) -> DataFrame:
    """Per run and field, the last value given and when: struct<at, v>. Such rows can be combined in any grouping."""
    at = F.struct(*order)

    def last_given(name: str) -> Column:
        given = at if name == STATE_FIELDS[0] else F.when(F.col(name).isNotNull(), at)
        return F.max_by(F.struct(at.alias("at"), F.col(name).alias("v")), given).alias(name)

    return log.groupBy("run_id").agg(*[last_given(f) for f in STATE_FIELDS])


def combined_state(parts: DataFrame) -> DataFrame:
    """One row per run out of several partial states."""
    return parts.groupBy("run_id").agg(*[F.max_by(f, F.col(f)["at"]).alias(f) for f in STATE_FIELDS])


def state_of(parts: DataFrame) -> DataFrame:
    return parts.select("run_id", *[F.col(f)["v"].alias(f) for f in STATE_FIELDS])
