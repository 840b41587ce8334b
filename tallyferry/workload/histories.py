"""History, ranking and rate queries (2.G, 2.M, F5-F8, E8, E9). Users act as jobs, events as runs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyferry.operators import history, numbering, rates, relations
from tallyferry.workload import Tables, register

_CONFIG = "concat('{\"entity\": \"', CASE user_id % 3 WHEN 0 THEN 'bill' WHEN 1 THEN 'vendor' ELSE 'invoice' END, '\"}')"
_JOB_COLUMNS = (
    "CASE WHEN user_id % 5 < 2 THEN 'import' ELSE 'export' END AS job_type",
    f"CASE WHEN user_id % 5 < 2 THEN NULL ELSE {_CONFIG} END AS export_config",
    f"CASE WHEN user_id % 5 < 2 THEN {_CONFIG} END AS import_config",
    "CASE WHEN user_id % 2 = 0 THEN '0 * * * *' END AS cron_schedule",
    "user_id % 7 <> 0 AS enabled",
)
_JOBS = (
    "jobs AS (SELECT user_id AS job_id, user_id % 4 AS client_id, created_at, " + ", ".join(_JOB_COLUMNS)
    + " FROM (SELECT user_id, min(ts) AS created_at FROM events GROUP BY user_id))"
)
_STATUS = (
    "CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'succeeded' END"
)
_RESULT_SPARK = "concat('{\"imported_count\": ', get_json_object(props, '$.k'), ', \"failed_count\": ', event_id % 3, '}')"
_RUNS = f"""runs AS (SELECT event_id AS run_id, user_id AS job_id, {_STATUS} AS status, ts AS created_at,
    CASE WHEN event_type <> 'view' THEN ts END AS started_at,
    CASE WHEN event_type NOT IN ('view', 'click') THEN ts + to_microseconds(CAST(floor(value * 1000) AS BIGINT) * 1000) END AS completed_at,
    CASE WHEN event_type = 'error' THEN 'boom ' || event_id END AS error_message,
    '{{"imported_count": ' || (props ->> '$.k') || ', "failed_count": ' || (event_id % 3) || '}}' AS result_metadata FROM events)"""
_WITH = f"WITH {_JOBS}, {_RUNS} "


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = Tables(spark, sf_dir)["event"].groupBy("user_id").agg(F.min("ts").alias("created_at"))
    return users.selectExpr("user_id AS job_id", "user_id % 4 AS client_id", "created_at", *_JOB_COLUMNS)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir)["event"].selectExpr(
        "event_id AS run_id", "user_id AS job_id", f"{_STATUS} AS status", "ts AS created_at",
        "CASE WHEN event_type <> 'view' THEN ts END AS started_at",
        "CASE WHEN event_type NOT IN ('view', 'click') THEN ts + make_dt_interval(0, 0, 0, CAST(floor(value * 1000) AS DECIMAL(18, 6)) / 1000) END AS completed_at",
        "CASE WHEN event_type = 'error' THEN concat('boom ', event_id) END AS error_message",
        f"{_RESULT_SPARK} AS result_metadata",
    )


START, END = datetime(2024, 1, 1, 2), datetime(2024, 1, 3)


def _jobs_page(spark: SparkSession, sf_dir: str) -> history.Page:
    return history.list_jobs(jobs(spark, sf_dir), 1, START, END, "export", "vendor", page=1, page_size=5)


_JOBS_FOUND = """found AS (SELECT * FROM jobs WHERE client_id = 1 AND created_at BETWEEN TIMESTAMP '2024-01-01 02:00:00' AND TIMESTAMP '2024-01-03'
    AND job_type = 'export' AND (export_config ->> '$.entity' = 'vendor' OR import_config ->> '$.entity' = 'vendor'))"""


@register(
    "history_jobs_page",
    f"WITH {_JOBS}, {_JOBS_FOUND} SELECT job_id, job_type, export_config, created_at FROM found ORDER BY created_at DESC, job_id LIMIT 5",
)
def history_jobs_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N1, D25-D27, H9."""
    return _jobs_page(spark, sf_dir).rows.select("job_id", "job_type", "export_config", "created_at")


@register(
    "history_jobs_totals",
    f"WITH {_JOBS}, {_JOBS_FOUND} SELECT count(*) AS total, CAST(ceil(count(*) / 5) AS BIGINT) AS total_pages FROM found",
)
def history_jobs_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6."""
    return _jobs_page(spark, sf_dir).totals


@register("history_scheduled_jobs", f"WITH {_JOBS} SELECT job_id FROM jobs WHERE enabled AND cron_schedule IS NOT NULL")
def history_scheduled_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D28."""
    return history.scheduled_jobs(jobs(spark, sf_dir)).select("job_id")


@register(
    "history_runs_of_job",
    f"""WITH {_RUNS} SELECT run_id, status, created_at FROM runs
        WHERE job_id = 7 AND created_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'""",
)
def history_runs_of_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N2."""
    found = history.list_runs(runs(spark, sf_dir), 7, datetime(2024, 1, 5), datetime(2024, 1, 25))
    return found.select("run_id", "status", "created_at")


@register(
    "history_last_run",
    _WITH + """SELECT j.job_id, j.job_type, r.run_id, r.status, r.started_at, r.completed_at, r.error_message FROM jobs j LEFT JOIN
       (SELECT * FROM runs WHERE status <> 'pending' QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, run_id DESC) = 1) r
       ON r.job_id = j.job_id""",
)
def history_last_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N3, E9."""
    ran = runs(spark, sf_dir).filter("status <> 'pending'")
    return history.jobs_with_last_run(jobs(spark, sf_dir), ran).select("job_id", "job_type", "last_run.*")


@register(
    "history_summary",
    f"""WITH {_RUNS} SELECT run_id, job_id, status,
        CAST(floor(date_diff('microsecond', started_at, completed_at) / 1000000 + 0.5) AS BIGINT) AS seconds,
        CASE WHEN status IN ('succeeded', 'failed') THEN CAST(result_metadata ->> '$.imported_count' AS BIGINT) END AS imported_count,
        CASE WHEN status IN ('succeeded', 'failed') THEN CAST(0 AS BIGINT) END AS updated_count,
        CASE WHEN status IN ('succeeded', 'failed') THEN CAST(0 AS BIGINT) END AS deleted_count,
        CASE WHEN status IN ('succeeded', 'failed') THEN CAST(0 AS BIGINT) END AS skipped_count,
        CASE WHEN status IN ('succeeded', 'failed') THEN CAST(result_metadata ->> '$.failed_count' AS BIGINT) END AS failed_count FROM runs""",
)
def history_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N4, F8."""
    return history.run_summary(runs(spark, sf_dir))


@register(
    "run_duration",
    f"""WITH {_RUNS} SELECT job_id, count(*) AS runs,
        CAST(sum(floor(date_diff('microsecond', started_at, completed_at) / 1000000 + 0.5)) AS BIGINT) AS seconds FROM runs GROUP BY 1""",
)
def run_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = history.run_summary(runs(spark, sf_dir))
    return done.groupBy("job_id").agg(F.count(F.lit(1)).alias("runs"), F.sum("seconds").alias("seconds"))


@register(
    "count_by_type",
    f"WITH {_JOBS} SELECT count(*) AS total, count(*) FILTER (job_type = 'export') AS exports, count(*) FILTER (job_type = 'import') AS imports FROM jobs",
)
def count_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5, N5."""
    return history.job_counts(jobs(spark, sf_dir))


@register(
    "latest_per_key",
    """SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders
       QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
)
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7, G1."""
    orders = Tables(spark, sf_dir)["order"]
    return history.latest(orders, "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderdate", "o_totalprice"])


@register(
    "owner_scoped_runs",
    _WITH + "SELECT run_id, status FROM runs WHERE job_id IN (SELECT job_id FROM jobs WHERE client_id = 2)",
)
def owner_scoped_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E8."""
    mine = relations.owned_runs(runs(spark, sf_dir), jobs(spark, sf_dir), F.col("client_id"), 2)
    return mine.select("run_id", "status")


@register(
    "status_fold",
    f"""WITH log AS (SELECT user_id AS run_id, event_id, ts, {_STATUS} AS status, CASE WHEN event_type = 'click' THEN ts END AS started_at,
          CASE WHEN event_type = 'purchase' THEN ts END AS completed_at, CASE WHEN event_type = 'error' THEN 'boom ' || event_id END AS error_message,
          CASE WHEN event_id % 4 = 0 THEN props END AS result_metadata FROM events)
        SELECT run_id, arg_max(status, ts) AS status, arg_max(started_at, ts) FILTER (started_at IS NOT NULL) AS started_at,
          arg_max(completed_at, ts) FILTER (completed_at IS NOT NULL) AS completed_at,
          arg_max(error_message, ts) FILTER (error_message IS NOT NULL) AS error_message,
          arg_max(result_metadata, ts) FILTER (result_metadata IS NOT NULL) AS result_metadata FROM log GROUP BY 1""",
)
def status_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events read as the status log of one run."""
    return history.fold_status(status_log(Tables(spark, sf_dir)["event"]), ["ts", "event_id"])


def status_log(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "user_id AS run_id", "event_id", "ts", f"{_STATUS} AS status", "CASE WHEN event_type = 'click' THEN ts END AS started_at",
        "CASE WHEN event_type = 'purchase' THEN ts END AS completed_at",
        "CASE WHEN event_type = 'error' THEN concat('boom ', event_id) END AS error_message",
        "CASE WHEN event_id % 4 = 0 THEN props END AS result_metadata",
    )


@register(
    "batch_id",
    "SELECT (o_orderkey // 1000) AS batch, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY 1",
)
def batch_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G3."""
    orders = Tables(spark, sf_dir)["order"].withColumn("batch", numbering.batch_id(F.col("o_orderkey") + 1, 1000))
    return orders.groupBy("batch").agg(
        F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last")
    )


@register(
    "running_progress",
    """WITH b AS (SELECT (event_id // 100) AS batch, count(*) AS "rows", count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1)
       SELECT batch, "rows", failed, CAST(sum("rows") OVER w AS BIGINT) AS running_rows, CAST(sum(failed) OVER w AS BIGINT) AS running_failed
       FROM b WINDOW w AS (ORDER BY batch)""",
)
def running_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2, N7."""
    events = Tables(spark, sf_dir)["event"].withColumn("row", F.col("event_id") + 1)
    return numbering.running_progress(events, "row", 100, {"failed": F.col("event_type") == "error"})


@register(
    "row_numbers_by_key",
    """WITH k AS (SELECT md5('customer ' || c_custkey) AS id, c_custkey, NULL AS o_orderkey FROM customer
                  UNION ALL SELECT md5('order ' || o_orderkey), NULL, o_orderkey FROM orders)
       SELECT c_custkey, o_orderkey, row_number() OVER (ORDER BY id) AS row FROM k""",
)
def row_numbers_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10 for two whole tables, by hashed ids."""
    tables = Tables(spark, sf_dir)
    customers = tables["customer"].select(F.md5(F.concat(F.lit("customer "), "c_custkey").cast("binary")).alias("id"), "c_custkey")
    orders = tables["order"].select(F.md5(F.concat(F.lit("order "), "o_orderkey").cast("binary")).alias("id"), "o_orderkey")
    return numbering.number_by_key(customers.unionByName(orders, allowMissingColumns=True), "id").drop("id")


@register(
    "running_totals_by_key",
    """SELECT o_orderkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER w AS BIGINT) AS running_cents,
              count(*) OVER w AS running_one
       FROM orders WINDOW w AS (ORDER BY md5(CAST(o_orderkey AS VARCHAR)) ROWS UNBOUNDED PRECEDING)""",
)
def running_totals_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals of all orders in the order of their hashed ids."""
    orders = Tables(spark, sf_dir)["order"].select(
        "o_orderkey", F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("id"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), F.lit(1).alias("one"),
    )
    return numbering.running_totals(orders, "id", ["cents", "one"]).drop("id", "cents", "one")


def _rate_sql(seconds: int) -> str:
    return f"""SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)
                 RANGE BETWEEN {seconds * 1_000_000 - 1} PRECEDING AND CURRENT ROW) - 1 AS last_{seconds}s FROM events"""


@register("rate_trailing_60s", _rate_sql(60))
def rate_trailing_60s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G5."""
    events = Tables(spark, sf_dir)["event"].select("event_id", "user_id", "ts")
    return rates.trailing_counts(events, "user_id", "ts", [60]).drop("ts")


@register("rate_trailing_1h", _rate_sql(3600))
def rate_trailing_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = Tables(spark, sf_dir)["event"].select("event_id", "user_id", "ts")
    return rates.trailing_counts(events, "user_id", "ts", [3600]).drop("ts")


@register(
    "rate_hot_key",
    """WITH c AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS k, epoch_us(ts) AS us FROM events),
       n AS (SELECT event_id, count(*) OVER (PARTITION BY k ORDER BY us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) - 1 AS last_60s,
                    count(*) OVER (PARTITION BY k ORDER BY us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) - 1 AS last_3600s FROM c)
       SELECT * FROM n WHERE last_60s >= 1 OR last_3600s >= 4""",
)
def rate_hot_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both spans at once, with a third of all events on one key, which goes by range partitions; over-limit
    requests only."""
    events = Tables(spark, sf_dir)["event"].selectExpr(
        "event_id", "CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS k", "ts"
    )
    counts = rates.trailing_counts(events, "k", "ts", [60, 3600], hot_rows=10)
    return rates.over_limit(counts, (1, 4)).select("event_id", "last_60s", "last_3600s")
