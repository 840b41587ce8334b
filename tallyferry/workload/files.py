"""File and stream queries (2.A, 2.B, 2.N). Files are written from the tables into the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyferry.operators import validation
from tallyferry.plans.catalog import BILL
from tallyferry.plans.imports import import_folder
from tallyferry.plans.specs import ImportSpec
from tallyferry.session import scratch_dir
from tallyferry.sources import files, inbox, sinks
from tallyferry.sources.snapshots import PartitionedTable
from tallyferry.streaming import jobs
from tallyferry.streaming.sources import stream_csv, stream_parquet
from tallyferry.workload import ORACLES, Tables, exports, histories, merges, register
from tallyferry.workload.validation import _WITH as BILLS_SQL, dirty_bills

# Quotes, commas and line breaks in a cell must survive the trip.
_AWKWARD = "CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN concat('a \"quoted\", name ', c_custkey) WHEN 2 THEN concat('two\\nlines ', c_custkey) ELSE c_name END"
_AWKWARD_SQL = "CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'a \"quoted\", name ' || c_custkey WHEN 2 THEN 'two' || chr(10) || 'lines ' || c_custkey ELSE c_name END"


def _awkward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir)["customer"].select(
        F.col("c_custkey").cast("string").alias("id"), F.expr(_AWKWARD).alias("name"), F.col("c_mktsegment").alias("segment")
    )


@register("csv_round_trip", f"SELECT CAST(c_custkey AS VARCHAR) AS id, {_AWKWARD_SQL} AS name, c_mktsegment AS segment FROM customer")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, B1: empty text comes back as null."""
    path = scratch_dir(spark, "csv")
    sinks.write_export(_awkward(spark, sf_dir), path)
    return files.scan_csv(spark, path)


@register(
    "csv_row_numbers",
    "SELECT o_orderkey // 10000 AS block, CAST(o_orderkey AS VARCHAR) AS id, row_number() OVER (PARTITION BY o_orderkey // 10000 ORDER BY o_orderkey) AS row FROM orders",
)
def csv_row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, A10: one file per 10,000 order numbers. Row numbers restart in each file and follow its order,
    also where a file is split over tasks."""
    path = scratch_dir(spark, "numbered")
    orders = Tables(spark, sf_dir)["order"].select(
        F.floor(F.col("o_orderkey") / 10000).alias("block"), F.col("o_orderkey").alias("id")
    )
    by_file = orders.repartition("block").sortWithinPartitions("block", "id")
    by_file.write.partitionBy("block").option("header", True).csv(path)
    numbered = files.number_rows(files.scan_csv(spark, path, quoted_newlines=False))
    return numbered.select(F.col("block").cast("long").alias("block"), "id", "row")


@register("json_round_trip", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_custkey % 2 = 0 AS even FROM customer")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines written and read with their types."""
    path = scratch_dir(spark, "json")
    rows = Tables(spark, sf_dir)["customer"].selectExpr(
        "c_custkey AS id", "c_name AS name", "c_acctbal AS balance", "c_custkey % 2 = 0 AS even"
    )
    sinks.write_export(rows, path, "json")
    return files.scan_json(spark, path, rows.schema, lines=True)


@register("json_array_scan", "SELECT n_nationkey AS id, n_name AS name FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def json_array_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: one file per customer segment, each a JSON array of objects."""
    path = scratch_dir(spark, "arrays")
    tables = Tables(spark, sf_dir)
    used = tables["customer"].join(tables["nation"], F.expr("c_nationkey = n_nationkey"))
    objects = F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    documents = used.groupBy("c_mktsegment").agg(F.to_json(F.collect_set(objects)).alias("value"))
    documents.select("value").repartition(5).write.text(path)
    return files.scan_json(spark, path, "id int, name string").distinct()


@register("jsonl_errors", BILLS_SQL + 'SELECT "row", field, message FROM errors')
def jsonl_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B4."""
    path = scratch_dir(spark, "errors")
    sinks.write_errors(validation.error_rows(validation.validate(dirty_bills(spark, sf_dir), BILL)), path)
    return spark.read.schema("row long, field string, message string").json(path)


@register(
    "json_record_problems",
    """SELECT conv_id, turn, CAST(2 AS BIGINT) AS row, 'Record must be an object' AS message FROM conversations
       WHERE conv_id % 10 > 1 AND role <> 'user'
       UNION ALL SELECT conv_id, turn, 0, CASE conv_id % 10 WHEN 0 THEN 'Invalid JSON' ELSE 'JSON must be an array or object' END
       FROM conversations WHERE conv_id % 10 <= 1""",
)
def json_record_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a JSON array of two records, of which the second is an object for user turns only.
    One document in ten is cut short, one is a bare text."""
    value = F.expr(
        "CASE conv_id % 10 WHEN 0 THEN concat('[', to_json(named_struct('text', text))) WHEN 1 THEN '\"text\"' "
        "ELSE concat('[', to_json(named_struct('text', text)), ', ', "
        "CASE WHEN role = 'user' THEN '{}' ELSE concat('\"', role, '\"') END, ']') END"
    )
    documents = Tables(spark, sf_dir).raw("conversations").select("conv_id", "turn", value.alias("value"))
    return files.json_document_problems(documents)


@register(
    "columns_discovered",
    """SELECT kind, c_mktsegment AS segment, CASE kind WHEN 'csv' THEN 'external_id,full name,amount' ELSE 'address,amount,name' END AS columns,
              kind = 'csv' AS has_action, count(DISTINCT c_mktsegment) AS files
       FROM customer, (VALUES ('csv'), ('json')) k(kind) GROUP BY ALL""",
)
def columns_discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One CSV file and one JSON object per customer segment."""
    path = scratch_dir(spark, "columns")
    customers = Tables(spark, sf_dir)["customer"].repartition(5, "c_mktsegment")
    customers.selectExpr(
        "c_mktsegment", "concat('C', c_custkey) AS external_id", "c_name AS `full name`", "'X' AS _action", "c_acctbal AS amount"
    ).write.partitionBy("c_mktsegment").option("header", True).csv(f"{path}/kind=csv")
    objects = customers.groupBy("c_mktsegment").agg(F.max("c_name").alias("name"), F.max("c_acctbal").alias("amount"), F.max("c_nationkey").alias("address"))
    objects.write.partitionBy("c_mktsegment").json(f"{path}/kind=json")
    found = inbox.discovered(spark, path).select(
        F.regexp_extract("file", "kind=([^/]*)", 1).alias("kind"), F.regexp_extract("file", "c_mktsegment=([^/]*)", 1).alias("segment"),
        F.array_join("columns", ",").alias("columns"), "has_action", "file",
    )
    return found.groupBy("kind", "segment", "columns", "has_action").agg(F.count_distinct("file").alias("files"))


@register(
    "file_gate",
    """SELECT kind, c_mktsegment AS segment, CASE kind WHEN 'txt' THEN 'Invalid file format. Allowed: .csv, .json' WHEN 'big' THEN 'File too large. Maximum size: 0.19073486328125MB' WHEN 'gone' THEN 'File not found: ' END AS message
       FROM customer, (VALUES ('csv'), ('txt'), ('big'), ('gone')) k(kind) GROUP BY ALL
       UNION ALL SELECT 'empty', '', 'File is empty'""",
)
def file_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8 over the files of each customer segment and kind; contents are not read."""
    path = scratch_dir(spark, "gate")
    rows = Tables(spark, sf_dir)["customer"].select("c_mktsegment", F.col("c_name").alias("value")).repartition(5, "c_mktsegment")
    segments = rows.select("c_mktsegment").distinct()
    # 1,000 rows a file at most, so that no file of this kind is too large
    rows.write.partitionBy("c_mktsegment").option("maxRecordsPerFile", 1000).csv(f"{path}/kind=csv")
    rows.write.partitionBy("c_mktsegment").text(f"{path}/kind=txt")
    segments.withColumn("value", F.repeat(F.lit("x"), 250_000)).write.partitionBy("c_mktsegment").csv(f"{path}/kind=big")
    segments.limit(0).write.csv(f"{path}/kind=empty")
    gone = segments.select(F.concat(F.lit(f"{path}/kind=gone/c_mktsegment="), "c_mktsegment", F.lit("/x.csv")).alias("path"))
    gated = inbox.inspect_names(spark, path, gone, 200_000)
    return gated.select(
        F.regexp_extract("path", "kind=([^/]*)", 1).alias("kind"), F.regexp_extract("path", "c_mktsegment=([^/]*)", 1).alias("segment"),
        F.regexp_replace("message", "found: .*", "found: ").alias("message"),
    ).distinct()


@register(
    "import_folder_checks",
    """WITH c AS (SELECT c_mktsegment AS segment, count(*) AS n, count(*) FILTER (c_custkey % 10 = 0) AS bad FROM customer GROUP BY 1)
       SELECT 'good' AS kind, segment, 'created' AS what, n FROM c
       UNION ALL SELECT 'partly', segment, 'Required field ''name'' is missing or empty', bad FROM c WHERE bad > 0
       UNION ALL SELECT 'latin', segment, 'File encoding error. File must be UTF-8 encoded', 1 FROM c
       UNION ALL SELECT 'wide', segment, 'CSV parsing error: field larger than field limit (131072)', 1 FROM c
       UNION ALL SELECT 'headless', segment, 'Missing required fields: name', 1 FROM c
       UNION ALL SELECT 'text', segment, 'Invalid file format. Allowed: .csv, .json', 1 FROM c
       UNION ALL SELECT 'empty', '', 'File is empty', 1
       UNION ALL SELECT 'object', segment, 'created', 1 FROM c
       UNION ALL SELECT 'cut', segment, 'Invalid JSON', 1 FROM c""",
)
def import_folder_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of every kind side by side in one import; the good ones are merged, whatever stands beside them.

    `partly` has one name in ten missing, so with `abort` its files are refused whole, each with a line per bad row.
    """
    path = scratch_dir(spark, "inbox")
    customers = Tables(spark, sf_dir)["customer"].repartition(5, "c_mktsegment")
    segments = customers.select("c_mktsegment").distinct()

    def put(df: DataFrame, kind: str, form: str = "csv", **options) -> None:
        writer = df.write.partitionBy("c_mktsegment").options(**options)
        getattr(writer, form)(f"{path}/kind={kind}")

    rows = customers.selectExpr("c_mktsegment", "concat('N', c_custkey) AS external_id", "c_name AS name", "c_acctbal AS amount")
    put(rows, "good", header=True)
    put(rows.selectExpr("* EXCEPT (external_id, name)", "concat('P', external_id) AS external_id",
                        "CASE WHEN substr(external_id, -1) <> '0' THEN name END AS name"), "partly", header=True)
    put(rows.withColumn("name", F.lit("caf\u00e9")), "latin", header=True, encoding="ISO-8859-1")
    put(segments.select("c_mktsegment", F.lit("W").alias("external_id"), F.repeat(F.lit("x"), 140_000).alias("name")), "wide", header=True)
    put(rows.select("c_mktsegment", "external_id", "amount"), "headless", header=True)
    put(rows.select("c_mktsegment", "name"), "text", "text")
    segments.limit(0).write.csv(f"{path}/kind=empty")
    one = segments.select("c_mktsegment", F.concat(F.lit("J"), "c_mktsegment").alias("external_id"), F.lit("one").alias("name"))
    put(one, "object", "json")
    put(one.unionByName(one).repartition(1), "cut", "json")
    done = import_folder(
        spark, path, ImportSpec.parse({"entity": "account"}), merges.Registry((merges.NATION, merges.account())),
        merges.accounts(spark, sf_dir).limit(0), merges.AS_OF, tenant=1, tables={"nation": Tables(spark, sf_dir)["nation"]},
    )
    told = done.errors.select("file", F.col("message").alias("what")).unionByName(done.outcomes.select("file", F.col("outcome").alias("what")))
    kind, segment = (F.regexp_extract("file", f"{c}=([^/]*)", 1) for c in ("kind", "c_mktsegment"))
    return told.groupBy(kind.alias("kind"), segment.alias("segment"), "what").agg(F.count(F.lit(1)).alias("n"))


@register(
    "export_written_counts",
    "SELECT 'csv' AS format, count(*) AS count, count(*) AS matched FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 4 = 3",
)
def export_written_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written rows are counted by the write itself, matches by the plan."""
    raw = {"entity": "order", "fields": ["id", {"field": "customer.name", "as": "Customer"}],
           "filters": {"field": "status", "operator": "eq", "value": "F"}}
    plan = exports.run_spec(spark, sf_dir, raw, tenant=3)
    path = sinks.export_path(scratch_dir(spark, "exports"), 3, "job-1", "run-1")
    written = sinks.write_export(plan.rows, path)
    matched = plan.matched().head()["matched"]
    return sinks.export_result(spark, written, matched, "csv", plan.rows.columns, path).select("format", "count", "matched")


@register("snapshot_rewrite", merges._sql() + "SELECT external_id, client_id, name, amount, status, nation_id FROM merged")
def snapshot_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merge that reads and rewrites only the key buckets its rows fall into."""
    base = merges.accounts(spark, sf_dir)
    table = PartitionedTable(spark, scratch_dir(spark, "snapshot"), base.schema, buckets=16)
    table.create(base)
    change = merges.changes(spark, sf_dir)

    def merged(rows: DataFrame) -> DataFrame:
        return merges.M.merge(
            rows, change, merges.account(), merges.AS_OF, tenant=1, registry=merges.Registry((merges.NATION,)),
            tables={"nation": Tables(spark, sf_dir)["nation"]}, run_id="r1", hold=merges.keep,
        ).table

    table.change(1, table.touched(change.select("external_id")), merged)
    return table.read().select("external_id", "client_id", "name", "amount", "status", "nation_id")


# -- streams ------------------------------------------------------------------------------------------


def _finish(query) -> None:
    query.awaitTermination()


@register(
    "stream_validation",
    BILLS_SQL + """SELECT 'error' AS kind, "row", field FROM errors UNION ALL
                   SELECT 'good', "row", NULL FROM bills WHERE "row" NOT IN (SELECT "row" FROM errors)""",
)
def stream_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dirty bills arrive as CSV files."""
    root = scratch_dir(spark, "stream-validation")
    bills = dirty_bills(spark, sf_dir)
    bills.write.option("header", True).option("quote", '"').option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(f"{root}/in")
    arriving = stream_csv(spark, f"{root}/in", bills.columns, files_per_batch=2)
    _finish(jobs.stream_validation(arriving, BILL, f"{root}/good", f"{root}/errors", f"{root}/checkpoint"))
    good = spark.read.parquet(f"{root}/good").select(F.lit("good").alias("kind"), F.col("row").cast("long").alias("row"))
    errors = spark.read.schema("row long, field string, message string").json(f"{root}/errors")
    return errors.select(F.lit("error").alias("kind"), "row", "field").unionByName(good, allowMissingColumns=True)


@register(
    "stream_ingest_merge",
    """WITH target AS (SELECT CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 'C' || c_custkey END AS external_id,
                              CASE WHEN c_custkey % 7 = 0 THEN 2 ELSE 1 END AS client_id, c_name AS name, c_acctbal AS amount, c_mktsegment AS status
                       FROM customer WHERE c_custkey % 3 <> 0),
       all_rows AS (SELECT o_orderkey AS r, CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE 'C' || o_custkey END AS external_id,
                     CASE WHEN o_orderkey % 17 = 0 THEN ' ' ELSE 'name ' || o_orderkey END AS name,
                     CASE WHEN o_orderkey % 13 = 0 THEN 'n/a' WHEN o_orderkey % 4 <> 0 THEN CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) END AS given,
                     CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS status FROM orders),
       ch AS (SELECT r, external_id, name, TRY_CAST(given AS DOUBLE) AS amount, status FROM all_rows WHERE trim(name) <> '' AND given IS DISTINCT FROM 'n/a'),
       lives AS (SELECT external_id, -1 AS r, name, amount, status FROM target WHERE client_id = 1 AND external_id IS NOT NULL
                 UNION ALL SELECT external_id, r, name, amount, status FROM ch WHERE external_id IS NOT NULL)
       SELECT 'row' AS kind, external_id, arg_max(name, r) AS name, arg_max(amount, r) FILTER (amount IS NOT NULL) AS amount,
              arg_max(status, r) FILTER (status IS NOT NULL) AS status, NULL AS "row", NULL AS message FROM lives GROUP BY external_id
       UNION ALL SELECT 'row', external_id, name, amount, status, NULL, NULL FROM target WHERE client_id <> 1 OR external_id IS NULL
       UNION ALL SELECT 'row', external_id, name, amount, status, NULL, NULL FROM ch WHERE external_id IS NULL
       UNION ALL SELECT 'refused', NULL, NULL, NULL, NULL, r + 1, 'Required field ''name'' is missing or empty' FROM all_rows WHERE trim(name) = ''
       UNION ALL SELECT 'refused', NULL, NULL, NULL, NULL, r + 1, 'Field ''amount'' must be a number' FROM all_rows WHERE given = 'n/a'""",
)
def stream_ingest_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders in three waves of files, with the rows that validation refuses. After each wave the stream is
    started again from its checkpoint."""
    root = scratch_dir(spark, "stream-import")
    base = merges.accounts(spark, sf_dir)
    table = PartitionedTable(spark, f"{root}/table", base.schema, buckets=8)
    table.create(base)
    change = merges.changes(spark, sf_dir, action=False).select("row", "external_id", "name", "amount", "status")
    last = change.agg(F.max("row")).head()[0] or 0
    edges = [last * i // 3 for i in range(4)]
    for low, high in zip(edges, edges[1:]):
        wave = change.filter((F.col("row") > low) & (F.col("row") <= high))
        wave.write.mode("append").option("header", True).option("ignoreTrailingWhiteSpace", False).option(
            "ignoreLeadingWhiteSpace", False
        ).csv(f"{root}/in")
        arriving = stream_csv(spark, f"{root}/in", change.columns)
        _finish(jobs.stream_import(arriving, merges.account(), table, f"{root}/log", f"{root}/checkpoint", merges.AS_OF, 1, "upsert"))
    refused = spark.read.schema("row long, field string, message string").json(f"{root}/log/errors")
    return table.read().select(F.lit("row").alias("kind"), "external_id", "name", "amount", "status").unionByName(
        refused.select(F.lit("refused").alias("kind"), "row", "message"), allowMissingColumns=True
    )


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_parquet(spark, f"{sf_dir}/events.parquet")


@register(
    "stream_rate_window",
    """WITH w AS (SELECT user_id, time_bucket(INTERVAL 10 SECOND, ts) - INTERVAL (10 * i) SECOND AS start FROM events, range(6) t(i))
       SELECT start, start + INTERVAL 60 SECOND AS "end", user_id, count(*) AS requests FROM w GROUP BY ALL""",
)
def stream_rate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows, those still open at the end of the data included."""
    root = scratch_dir(spark, "stream-rates")
    _finish(jobs.stream_rates(_events(spark, sf_dir).select("ts", "user_id"), "user_id", "ts", f"{root}/out", f"{root}/checkpoint"))
    return jobs.windows_so_far(spark, f"{root}/out", f"{root}/checkpoint", ["requests"])


_CLASS = "CASE event_type WHEN 'purchase' THEN 'export' WHEN 'error' THEN 'upload' WHEN 'click' THEN 'import' ELSE event_type END"


@register(
    "stream_rate_limits",
    f"""WITH e AS (SELECT ts, user_id % 5 AS sender, {_CLASS} AS class FROM events),
        w AS (SELECT sender, class, 60 AS span, time_bucket(INTERVAL 10 SECOND, ts) - INTERVAL (10 * i) SECOND AS start FROM e, range(6) t(i)
              UNION ALL
              SELECT sender, class, 3600, time_bucket(INTERVAL 10 MINUTE, ts) - INTERVAL (600 * i) SECOND FROM e, range(6) t(i)),
        c AS (SELECT span, class, sender, start, count(*) AS requests FROM w GROUP BY ALL),
        l(class, minute, hour) AS (VALUES ('export', 2, 10), ('import', 1, 8), ('upload', 1, 2), ('default', 3, 20))
        SELECT span, c.class, count(*) AS windows, CAST(sum(requests) AS BIGINT) AS requests,
               CAST(sum(greatest(requests - CASE span WHEN 60 THEN coalesce(l.minute, 3) ELSE coalesce(l.hour, 20) END, 0)) AS BIGINT) AS over
        FROM c LEFT JOIN l ON l.class = c.class GROUP BY ALL""",
)
def stream_rate_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minute and hour windows of one job, and by class the requests beyond its limits (small ones, so that some are)."""
    root = scratch_dir(spark, "stream-limits")
    limits = {"export": (2, 10), "import": (1, 8), "upload": (1, 2), "default": (3, 20)}
    sent = _events(spark, sf_dir).selectExpr("ts", "user_id % 5 AS sender", f"{_CLASS} AS class")
    _finish(jobs.stream_rates(sent, ["sender", "class"], "ts", f"{root}/out", f"{root}/checkpoint", (jobs.MINUTE, jobs.HOUR)))
    windows = jobs.beyond_limits(jobs.windows_so_far(spark, f"{root}/out", f"{root}/checkpoint", ["requests"], 2), "class", limits)
    span = F.unix_timestamp(F.col("end").cast("timestamp")) - F.unix_timestamp(F.col("start").cast("timestamp"))
    return windows.groupBy(span.cast("int").alias("span"), "class").agg(
        F.count(F.lit(1)).alias("windows"), F.sum("requests").alias("requests"), F.sum("over").alias("over")
    )


@register(
    "stream_progress",
    """SELECT time_bucket(INTERVAL 5 SECOND, ts) + INTERVAL 5 SECOND AS "at", count(*) AS "rows",
              count(*) FILTER (event_type = 'error') AS flagged FROM events GROUP BY ALL""",
)
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: all intervals, the last ones included."""
    root = scratch_dir(spark, "stream-progress")
    events = _events(spark, sf_dir).withColumn("bad", F.col("event_type") == "error")
    _finish(jobs.stream_progress(events, "ts", "bad", f"{root}/out", f"{root}/checkpoint"))
    lines = jobs.windows_so_far(spark, f"{root}/out", f"{root}/checkpoint", ["rows", "flagged"])
    return lines.select(F.col("end").alias("at"), "rows", "flagged")


@register("stream_dedup", "SELECT event_id, ts, user_id FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third event is delivered three times."""
    root = scratch_dir(spark, "stream-dedup")
    again = F.explode(F.expr("CASE WHEN event_id % 3 = 0 THEN array(1, 2, 3) ELSE array(1) END"))
    delivered = _events(spark, sf_dir).select("event_id", "ts", "user_id").withColumn("delivery", again).drop("delivery")
    _finish(jobs.stream_dedup(delivered, "event_id", "ts", f"{root}/out", f"{root}/checkpoint"))
    return spark.read.parquet(f"{root}/out").drop("batch")


@register("stream_latest_state", ORACLES["status_fold"])
def stream_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming twin of `status_fold`; one whole state is read."""
    root = scratch_dir(spark, "stream-state")
    log = histories.status_log(_events(spark, sf_dir))
    _finish(jobs.stream_latest_state(log, ["ts", "event_id"], f"{root}/out", f"{root}/checkpoint", epoch=1))
    last = spark.read.parquet(f"{root}/out/whole").agg(F.max("epoch")).head()[0] or 0
    return jobs.read_latest_state(spark, f"{root}/out", log, ["ts", "event_id"], last)
