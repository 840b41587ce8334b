"""Validation queries (2.K, F2, F4, I1). Orders are made dirty by order number, lines by order and line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyferry.functions import dates, numbers
from tallyferry.functions.text import SCRIPT_MARKERS, SQL_MARKERS, contains_any, count_marker, is_blank
from tallyferry.operators import validation
from tallyferry.plans.catalog import BILL
from tallyferry.sources.files import ACTION, encoding_problems
from tallyferry.workload import Tables, register

# An import file of bills derived from the orders: (column, Spark SQL expression, DuckDB expression).
_DAY = "date_format(o_orderdate, 'yyyy-MM-dd')"
_DAY_SQL = "strftime(o_orderdate, '%Y-%m-%d')"
_CELLS = (
    ("row", "o_orderkey + 1", "o_orderkey + 1"),
    (
        "external_id",
        "CASE WHEN o_orderkey % 19 = 3 THEN NULL ELSE concat('B-', o_orderkey) END",
        "CASE WHEN o_orderkey % 19 = 3 THEN NULL ELSE 'B-' || o_orderkey END",
    ),
    (
        "amount",
        "CASE o_orderkey % 11 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN 'twelve' WHEN 3 THEN '-5' "
        "WHEN 4 THEN '1_000' WHEN 5 THEN '12.5d' WHEN 6 THEN '0' WHEN 7 THEN '1e3' "
        "ELSE CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS STRING) END",
        "CASE o_orderkey % 11 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN 'twelve' WHEN 3 THEN '-5' "
        "WHEN 4 THEN '1_000' WHEN 5 THEN '12.5d' WHEN 6 THEN '0' WHEN 7 THEN '1e3' "
        "ELSE CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) END",
    ),
    (
        "date",
        f"CASE o_orderkey % 13 WHEN 0 THEN NULL WHEN 1 THEN '15/01/2024' WHEN 2 THEN '2024-13-45' ELSE {_DAY} END",
        f"CASE o_orderkey % 13 WHEN 0 THEN NULL WHEN 1 THEN '15/01/2024' WHEN 2 THEN '2024-13-45' ELSE {_DAY_SQL} END",
    ),
    (
        "due_date",
        "CASE o_orderkey % 6 WHEN 0 THEN '1990-1-5' WHEN 1 THEN 'soon' WHEN 2 THEN NULL ELSE '2030-12-31' END",
        "CASE o_orderkey % 6 WHEN 0 THEN '1990-1-5' WHEN 1 THEN 'soon' WHEN 2 THEN NULL ELSE '2030-12-31' END",
    ),
    (
        "description",
        "CASE o_orderkey % 17 WHEN 0 THEN '''; DROP TABLE bills; --' WHEN 1 THEN '<SCRIPT>x()</SCRIPT>' "
        "WHEN 2 THEN 'JavaScript:run() -- now' WHEN 3 THEN 'Union Pacific, Select Staffing' "
        "ELSE o_orderpriority END",
        "CASE o_orderkey % 17 WHEN 0 THEN '''; DROP TABLE bills; --' WHEN 1 THEN '<SCRIPT>x()</SCRIPT>' "
        "WHEN 2 THEN 'JavaScript:run() -- now' WHEN 3 THEN 'Union Pacific, Select Staffing' "
        "ELSE o_orderpriority END",
    ),
)
_ACTION = (
    ACTION,
    "CASE o_orderkey % 8 WHEN 0 THEN 'C' WHEN 1 THEN ' update ' WHEN 2 THEN 'x' WHEN 3 THEN 'DELETE' "
    "WHEN 4 THEN 'merge' WHEN 5 THEN '' ELSE 'insert' END",
    "CASE o_orderkey % 8 WHEN 0 THEN 'C' WHEN 1 THEN ' update ' WHEN 2 THEN 'x' WHEN 3 THEN 'DELETE' "
    "WHEN 4 THEN 'merge' WHEN 5 THEN '' ELSE 'insert' END",
)


def dirty_bills(spark: SparkSession, sf_dir: str, action: bool = False) -> DataFrame:
    cells = _CELLS + ((_ACTION,) if action else ())
    orders = Tables(spark, sf_dir)["order"]
    return orders.select(*[F.expr(e).alias(name) for name, e, _ in cells])


def _dirty_sql(action: bool = False) -> str:
    cells = _CELLS + ((_ACTION,) if action else ())
    return "SELECT " + ", ".join(f'{e} AS "{name}"' for name, _, e in cells) + " FROM orders"


_NUMBER = (
    r"regexp_full_match(amount, '\s*[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?([eE][+-]?\d+)?|\.\d+(_\d+)*([eE][+-]?\d+)?)\s*')"
)
_AMOUNT = f"CASE WHEN {_NUMBER} THEN TRY_CAST(replace(trim(amount), '_', '') AS DOUBLE) END"
_LOOSE = r"regexp_full_match({c}, '\d{{4}}-\d{{1,2}}-\d{{1,2}}')"
_TEXT_CELLS = ("external_id", "amount", "date", "due_date", "description")


def _any(cell: str, markers: tuple[str, ...]) -> str:
    return "(" + " OR ".join("contains(lower({}), '{}')".format(cell, m.replace("'", "''")) for m in markers) + ")"


# The rules in reporting order: (place, field, message, condition).
_RULES: list[tuple[str, str, str]] = [
    (f, f"Required field '{f}' is missing or empty", f"{f} IS NULL OR trim({f}) = ''") for f in ("amount", "date")
]
for _cell in _TEXT_CELLS:
    _given = f"{_cell} IS NOT NULL AND {_cell} <> ''"
    _RULES.append((_cell, f"Potentially malicious content detected in field '{_cell}'", f"{_given} AND {_any(_cell, SQL_MARKERS)}"))
    _RULES.append((_cell, f"Potentially malicious script content in field '{_cell}'", f"{_given} AND {_any(_cell, SCRIPT_MARKERS)}"))
    if _cell == "amount":
        _RULES.append((_cell, "Field 'amount' must be a number", f"{_given} AND ({_AMOUNT}) IS NULL"))
    if _cell == "date":
        _RULES.append((_cell, "Field 'date' must be in YYYY-MM-DD format", f"{_given} AND NOT regexp_full_match(date, '\\d{{4}}-\\d{{2}}-\\d{{2}}')"))
_RULES.append(("amount", "Amount must be greater than zero", f"({_AMOUNT}) <= 0"))
_RULES.append((
    "due_date", "Due date cannot be before the bill date",
    f"{_LOOSE.format(c='due_date')} AND {_LOOSE.format(c='date')} AND TRY_CAST(due_date AS DATE) < TRY_CAST(date AS DATE)",
))


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_ERRORS_SQL = " UNION ALL ".join(
    f"SELECT \"row\", {i} AS place, {_q(f)} AS field, {_q(m)} AS message FROM bills WHERE {cond}"
    for i, (f, m, cond) in enumerate(_RULES)
)
_WITH = f"WITH bills AS ({_dirty_sql()}), errors AS ({_ERRORS_SQL}) "

_BAD_ACTION = (
    "'Invalid action ''' || _action || '''. Use CREATE/C, UPDATE/U, UPSERT/X, or DELETE/D'"
)
# With actions: deletions report only a missing key, unknown actions only themselves.
_ACTION_WITH = (
    f"WITH bills_all AS ({_dirty_sql(True)}), "
    "norm AS (SELECT *, CASE WHEN upper(trim(_action)) IN ('C', 'CREATE', 'I', 'INSERT') THEN 'create' "
    "WHEN upper(trim(_action)) IN ('U', 'UPDATE') THEN 'update' WHEN upper(trim(_action)) IN ('X', 'UPSERT') THEN 'upsert' "
    "WHEN upper(trim(_action)) IN ('D', 'DELETE') THEN 'delete' END AS action FROM bills_all), "
    "bills AS (SELECT * FROM norm WHERE (_action = '' OR action IS NOT NULL) AND coalesce(action, '') <> 'delete'), "
    f"plain AS ({_ERRORS_SQL}), "
    "errors AS (SELECT * FROM plain UNION ALL "
    "SELECT \"row\", 90, 'external_id', 'external_id is required for DELETE action' FROM norm WHERE action = 'delete' AND external_id IS NULL "
    f"UNION ALL SELECT \"row\", 91, '_action', {_BAD_ACTION} FROM norm WHERE action IS NULL AND _action <> '') "
)


def _validated(spark: SparkSession, sf_dir: str, action: bool = False) -> DataFrame:
    """Bills with their errors, checked row by row as an import does it."""
    return validation.validate(dirty_bills(spark, sf_dir, action), BILL)


@register("validate_errors", _WITH + "SELECT \"row\", field, message FROM errors")
def validate_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.error_rows(_validated(spark, sf_dir))


@register(
    "validate_error_order",
    _WITH + "SELECT \"row\", string_agg(field || ': ' || message, '; ' ORDER BY place) AS errors FROM errors GROUP BY 1",
)
def validate_error_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The errors of a row in reporting order, as one text."""
    said = F.transform("errors", lambda e: F.concat(e["field"], F.lit(": "), e["message"]))
    return _validated(spark, sf_dir).filter(~F.col("is_valid")).select("row", F.concat_ws("; ", said).alias("errors"))


@register(
    "validate_counts",
    _WITH + """SELECT (SELECT count(*) FROM bills) AS total,
       (SELECT count(*) FROM bills WHERE "row" NOT IN (SELECT "row" FROM errors)) AS valid,
       (SELECT count(DISTINCT "row") FROM errors) AS invalid, (SELECT count(*) FROM errors) AS error_count""",
)
def validate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.summary(_validated(spark, sf_dir))


@register(
    "validate_actions",
    _ACTION_WITH + "SELECT \"row\", string_agg(field || ': ' || message, '; ' ORDER BY place) AS errors FROM errors GROUP BY 1",
)
def validate_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file with an action column."""
    said = F.transform("errors", lambda e: F.concat(e["field"], F.lit(": "), e["message"]))
    checked = _validated(spark, sf_dir, action=True).filter(~F.col("is_valid"))
    return checked.select("row", F.concat_ws("; ", said).alias("errors"))


@register(
    "validate_preview",
    (
        _ACTION_WITH.replace(
            "bills AS (SELECT * FROM norm WHERE (_action = '' OR action IS NOT NULL) AND coalesce(action, '') <> 'delete')",
            "bills AS (SELECT * FROM norm WHERE coalesce(action, '') <> 'delete')",
        )
        + """, shown AS (SELECT * FROM errors UNION ALL
             SELECT "row", 92, '_action', 'Action is required when _action column is present' FROM norm WHERE _action = ''),
           said AS (SELECT "row", string_agg(field || ': ' || message, '; ' ORDER BY place) AS errors FROM shown GROUP BY 1)
           SELECT n."row", n.external_id, n.amount, n.action, s.errors IS NULL AS is_valid, coalesce(s.errors, '') AS errors
           FROM norm n LEFT JOIN said s ON s."row" = n."row" """
    ).replace(") , shown", "), shown"),
)
def validate_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with its status; action errors come last."""
    shown = validation.preview(dirty_bills(spark, sf_dir, action=True), BILL)
    said = F.transform("errors", lambda e: F.concat(e["field"], F.lit(": "), e["message"]))
    return shown.select(
        "row", "data.external_id", "data.amount", "action", "is_valid", F.concat_ws("; ", said).alias("errors")
    )


@register("validate_split", _WITH + "SELECT \"row\", external_id FROM bills WHERE \"row\" NOT IN (SELECT \"row\" FROM errors)")
def validate_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K19 with `skip`: the valid rows go on."""
    good, _ = validation.split(_validated(spark, sf_dir), "skip")
    return good.select("row", "external_id")


@register("validate_abort", _WITH + "SELECT \"row\", external_id FROM bills WHERE (SELECT count(*) FROM errors) = 0")
def validate_abort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K19 with `abort`: one invalid row stops the whole file."""
    good, _ = validation.split(_validated(spark, sf_dir), "abort")
    return good.select("row", "external_id")


@register("rule_required", "SELECT o_orderkey FROM orders WHERE o_orderkey % 11 IN (0, 1)")
def rule_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    bills = dirty_bills(spark, sf_dir)
    return bills.filter(is_blank(F.col("amount"))).select((F.col("row") - 1).alias("o_orderkey"))


@register("rule_number", f"WITH bills AS ({_dirty_sql()}) SELECT \"row\", {_AMOUNT} AS amount FROM bills")
def rule_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dirty_bills(spark, sf_dir).select("row", numbers.parse_number(F.col("amount")).alias("amount"))


@register(
    "rule_decimal",
    f"WITH bills AS ({_dirty_sql()}) SELECT \"row\", CAST(({_AMOUNT}) AS DECIMAL(15,2)) AS amount FROM bills",
)
def rule_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dirty_bills(spark, sf_dir).select("row", numbers.parse_decimal(F.col("amount")).alias("amount"))


@register(
    "rule_date",
    f"""WITH bills AS ({_dirty_sql()}) SELECT "row", regexp_full_match(date, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AS shaped,
        CASE WHEN {_LOOSE.format(c='due_date')} THEN TRY_CAST(due_date AS DATE) END AS due FROM bills""",
)
def rule_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    bills = dirty_bills(spark, sf_dir)
    return bills.select(
        "row", dates.has_iso_date_shape(F.col("date")).alias("shaped"), dates.parse_day(F.col("due_date")).alias("due")
    )


@register(
    "parse_timestamps",
    """SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL WHEN 0 THEN date_trunc('second', ts)
                 WHEN 1 THEN date_trunc('second', ts) - INTERVAL 330 MINUTE ELSE date_trunc('day', ts) END AS stamp
       FROM events""",
)
def parse_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamps with Z, with an offset, date only, and unreadable."""
    raw = F.expr(
        "CASE event_id % 4 WHEN 0 THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") "
        "WHEN 1 THEN date_format(ts, \"yyyy-MM-dd HH:mm:ss'+05:30'\") WHEN 2 THEN date_format(ts, 'yyyy-MM-dd') "
        "ELSE date_format(ts, 'dd.MM.yyyy') END"
    )
    return Tables(spark, sf_dir)["event"].select("event_id", dates.parse_timestamp(raw).alias("stamp"))


@register(
    "rule_custom",
    _WITH + "SELECT \"row\", field FROM errors WHERE message IN ('Amount must be greater than zero', 'Due date cannot be before the bill date')",
)
def rule_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7-K9: the entity's own rules alone."""
    bills = dirty_bills(spark, sf_dir)
    cells = {c: F.col(c) for c in bills.columns}
    own = [rule.compile(cells) for rule in BILL.rules]
    broken = F.explode(F.array(*[F.when(f.when, F.lit(f.field)) for f in own])).alias("field")
    return bills.select("row", broken).filter("field IS NOT NULL")


@register(
    "rule_action",
    _ACTION_WITH + "SELECT \"row\", action FROM norm",
)
def rule_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3."""
    shown = validation.preview(dirty_bills(spark, sf_dir, action=True), BILL)
    return shown.select("row", "action")


@register(
    "missing_columns",
    """WITH f AS (SELECT conv_id, list(DISTINCT role) AS present FROM conversations GROUP BY conv_id)
       SELECT conv_id, array_to_string(list_sort(list_filter(['assistant', 'system', 'user'], lambda x: NOT list_contains(present, x))), ', ') AS missing
       FROM f""",
)
def missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I1 over many inputs at once: each conversation is checked for the roles it must have."""
    present = Tables(spark, sf_dir).raw("conversations").groupBy("conv_id").agg(F.collect_set("role").alias("present"))
    required = F.array(F.lit("assistant"), F.lit("system"), F.lit("user"))
    lacking = validation.missing_columns(required, F.col("present"))
    return present.select("conv_id", F.concat_ws(", ", F.array_sort(lacking)).alias("missing"))


def _count_sql(cell: str, marker: str) -> str:
    m = marker.replace("'", "''")
    return f"CAST((length({cell}) - length(replace(lower({cell}), '{m}', ''))) / {len(marker)} AS BIGINT)"


def _per_marker(spark: SparkSession, sf_dir: str, markers: tuple[str, ...]) -> DataFrame:
    pages = Tables(spark, sf_dir)["page"]
    counts = F.array(*[
        F.struct(F.lit(m).alias("marker"), count_marker(F.col("html"), m).cast("long").alias("n")) for m in markers
    ])
    return (
        pages.select("page_id", F.explode(counts).alias("c"))
        .select("page_id", "c.marker", "c.n")
        .filter("n > 0")
    )


def _per_marker_sql(markers: tuple[str, ...]) -> str:
    parts = " UNION ALL ".join(
        f"SELECT page_id, {_q(m)} AS marker, {_count_sql('html', m)} AS n FROM pages" for m in markers
    )
    return f"SELECT * FROM ({parts}) WHERE n > 0"


@register("scan_sql_markers", _per_marker_sql(SQL_MARKERS))
def scan_sql_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: occurrences of each marker in whole page texts."""
    return _per_marker(spark, sf_dir, SQL_MARKERS)


@register("scan_script_markers", _per_marker_sql(SCRIPT_MARKERS))
def scan_script_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3."""
    return _per_marker(spark, sf_dir, SCRIPT_MARKERS)


@register(
    "scan_documents",
    f"""WITH d AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN text || ' SP_help' WHEN 1 THEN 'see <Script' || text
                                       WHEN 2 THEN text || ' /* note */ OnError=' ELSE text END AS text FROM documents)
        SELECT doc_id, {_any('text', SQL_MARKERS)} AS sql_marker, {_any('text', SCRIPT_MARKERS)} AS script_marker FROM d""",
)
def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2, K3 over whole document texts, some with markers added."""
    text = F.expr(
        "CASE doc_id % 9 WHEN 0 THEN concat(text, ' SP_help') WHEN 1 THEN concat('see <Script', text) "
        "WHEN 2 THEN concat(text, ' /* note */ OnError=') ELSE text END"
    )
    docs = Tables(spark, sf_dir)["document"].select("doc_id", text.alias("text"))
    return docs.select(
        "doc_id",
        contains_any(F.col("text"), SQL_MARKERS).alias("sql_marker"),
        contains_any(F.col("text"), SCRIPT_MARKERS).alias("script_marker"),
    )


@register("encoding_check", "SELECT doc_id, contains(text, '�') AS damaged FROM documents")
def encoding_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replacement character marks bytes that were not UTF-8."""
    docs = Tables(spark, sf_dir)["document"].select("doc_id", "text")
    return docs.select("doc_id", encoding_problems(docs).alias("damaged"))
