"""Merge queries (2.L, F3, F10). Customers are the table, orders make the import file.

The table holds the customers whose number is not divisible by 3, spread over two tenants; the merge
runs for tenant 1. Orders give several rows per customer key, in order-number order.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tallyferry.operators import merge as M
from tallyferry.plans.registry import EntityDef, FieldDef, ForeignKey, MergeColumn, Registry
from tallyferry.session import keep
from tallyferry.sources.files import ACTION
from tallyferry.workload import Tables, register

AS_OF = datetime(2002, 2, 3, 4, 5, 6)

_MONEY = T.DoubleType()


def account(overlay: str = "keep") -> EntityDef:
    return EntityDef(
        name="account",
        label="Accounts",
        fields=(
            FieldDef("id", "string", "ID"), FieldDef("external_id", "string", "External ID"),
            FieldDef("name", "string", "Name", required=True), FieldDef("amount", "number", "Amount"),
        ),
        required=("name",),
        overlay=overlay,
        merge_columns=(
            MergeColumn("external_id"),
            MergeColumn("name", default=""),
            MergeColumn("amount", type="number", data_type=_MONEY, default="0"),
            MergeColumn("status", default="active"),
        ),
        foreign_keys=(ForeignKey("nation_id", "nation", external="nation_external_id"),),
    )


NATION = EntityDef(
    name="nation", label="Nations", fields=(FieldDef("id"), FieldDef("external_id"), FieldDef("name")),
    tenant=None, columns={"id": "n_nationkey", "external_id": "n_name", "name": "n_name"},
)

# (column, Spark SQL, DuckDB SQL)
_TABLE = (
    ("id", "concat('id-', c_custkey)", "'id-' || c_custkey"),
    ("client_id", "CASE WHEN c_custkey % 7 = 0 THEN 2 ELSE 1 END", "CASE WHEN c_custkey % 7 = 0 THEN 2 ELSE 1 END"),
    ("external_id", "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE concat('C', c_custkey) END",
     "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 'C' || c_custkey END"),
    ("name", "c_name", "c_name"),
    ("amount", "c_acctbal", "c_acctbal"),
    ("status", "c_mktsegment", "c_mktsegment"),
    ("nation_id", "CAST(c_nationkey AS STRING)", "CAST(c_nationkey AS VARCHAR)"),
    ("updated_at", "TIMESTAMP_NTZ '2001-01-01 00:00:00'", "TIMESTAMP '2001-01-01 00:00:00'"),
)
_CHANGES = (
    ("row", "o_orderkey + 1", "o_orderkey + 1"),
    ("_action",
     "CASE o_orderkey % 9 WHEN 0 THEN 'C' WHEN 1 THEN 'U' WHEN 2 THEN 'D' WHEN 3 THEN 'X' WHEN 4 THEN 'u' "
     "WHEN 5 THEN 'create' WHEN 6 THEN 'D' WHEN 7 THEN 'upsert' ELSE 'oops' END", None),
    ("external_id",
     "CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE concat('C', o_custkey) END",
     "CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE 'C' || o_custkey END"),
    ("name",
     "CASE WHEN o_orderkey % 17 = 0 THEN ' ' ELSE concat('name ', o_orderkey) END",
     "CASE WHEN o_orderkey % 17 = 0 THEN ' ' ELSE 'name ' || o_orderkey END"),
    ("amount",
     "CASE WHEN o_orderkey % 13 = 0 THEN 'n/a' WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS STRING) END",
     "CASE WHEN o_orderkey % 13 = 0 THEN 'n/a' WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) END"),
    ("status",
     "CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderstatus END",
     "CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderstatus END"),
    ("nation_external_id",
     "concat('NATION_', o_orderkey % 40)", "'NATION_' || (o_orderkey % 40)"),
)


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = Tables(spark, sf_dir)["customer"].filter("c_custkey % 3 <> 0")
    return customers.select(*[F.expr(e).alias(name) for name, e, _ in _TABLE])


def changes(spark: SparkSession, sf_dir: str, action: bool = True) -> DataFrame:
    orders = Tables(spark, sf_dir)["order"]
    return orders.select(*[F.expr(e).alias(n) for n, e, _ in _CHANGES if action or n != ACTION])


def run(
    spark: SparkSession, sf_dir: str, mode: str = "create", overlay: str = "keep", action: bool = True, **kw,
) -> M.Merge:
    tables = {"nation": Tables(spark, sf_dir)["nation"]}
    return M.merge(
        accounts(spark, sf_dir), changes(spark, sf_dir, action), account(overlay), AS_OF, tenant=1, mode=mode,
        tables=tables, registry=Registry((NATION,)), run_id="r1",
        hold=keep, **kw,
    )


def _sql(mode: str | None = None, overlay: str = "keep") -> str:
    """The same merge in SQL, up to CTEs `outcomes` and `merged`. `mode` None uses the action column."""
    table = ", ".join(f'{d} AS "{n}"' for n, _, d in _TABLE)
    cells = ", ".join(f'{d or s} AS "{n}"' for n, s, d in _CHANGES)
    action = f"'{mode}'" if mode else (
        "CASE upper(_action) WHEN 'C' THEN 'create' WHEN 'CREATE' THEN 'create' WHEN 'U' THEN 'update' "
        "WHEN 'D' THEN 'delete' WHEN 'X' THEN 'upsert' WHEN 'UPSERT' THEN 'upsert' END"
    )
    replace = "true" if overlay == "replace" else "false"
    return f"""
    WITH target AS (SELECT {table} FROM customer WHERE c_custkey % 3 <> 0),
    raw AS (SELECT {cells} FROM orders),
    acted AS (SELECT *, {action} AS action FROM raw),
    typed AS (SELECT *, TRY_CAST(amount AS DOUBLE) AS num, amount = 'n/a' AS bad FROM acted),
    judged AS (SELECT *, CASE
        WHEN action IS NULL THEN 'Invalid action ''' || _action || ''''
        WHEN action = 'delete' AND external_id IS NULL THEN 'Match key ''external_id'' required for DELETE'
        WHEN action <> 'delete' AND trim(name) = '' THEN 'Required field ''name'' is missing or empty'
        WHEN action = 'update' AND external_id IS NULL THEN 'Match key ''external_id'' is required for UPDATE mode' END AS refusal
      FROM typed),
    keyed AS (SELECT *, CASE WHEN refusal IS NULL THEN external_id END AS k FROM judged),
    log AS (
      SELECT k, "row" AS r, CASE WHEN action = 'delete' THEN false WHEN action IN ('create', 'upsert') AND NOT coalesce(bad, false) THEN true END AS signal
        FROM keyed WHERE k IS NOT NULL
      UNION ALL SELECT external_id, 0, true FROM target WHERE client_id = 1 AND external_id IS NOT NULL),
    state AS (SELECT k, r, coalesce(last_value(signal IGNORE NULLS) OVER (PARTITION BY k ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS present FROM log),
    seen AS (SELECT keyed.*, coalesce(state.present, false) AS present FROM keyed LEFT JOIN state ON state.k = keyed.k AND state.r = keyed."row"),
    plain AS (SELECT *, CASE WHEN refusal IS NOT NULL THEN 'failed' WHEN action = 'delete' THEN CASE WHEN present THEN 'deleted' ELSE 'skipped' END
        WHEN action = 'create' THEN CASE WHEN present THEN 'failed' ELSE 'created' END
        WHEN action = 'update' THEN CASE WHEN present THEN 'updated' ELSE 'skipped' END
        ELSE CASE WHEN present THEN 'updated' ELSE 'created' END END AS o FROM seen),
    applied AS (SELECT *, CASE WHEN o IN ('created', 'updated') AND coalesce(bad, false) THEN 'failed' ELSE o END AS outcome FROM plain),
    outcomes AS (SELECT "row", outcome, CASE
        WHEN refusal IS NOT NULL THEN CASE WHEN action IS NULL THEN '_action' WHEN action = 'delete' OR refusal LIKE 'Match%' THEN 'external_id' ELSE 'name' END
        WHEN outcome = 'failed' AND o <> 'failed' THEN 'amount' END AS field,
        CASE WHEN refusal IS NOT NULL THEN refusal WHEN outcome = 'failed' AND o <> 'failed' THEN 'Failed to import record: invalid value for ''amount'''
             WHEN outcome = 'failed' THEN 'Record with external_id=''' || external_id || ''' already exists' END AS message
      FROM applied),
    lives AS (
      SELECT external_id AS k, 0 AS r, 'base' AS outcome, name, amount AS num, status, nation_id, updated_at, NULL AS born, true AS full_row FROM target
        WHERE client_id = 1 AND external_id IS NOT NULL
      UNION ALL SELECT a.k, a."row", a.outcome,
          a.name, CASE WHEN a.outcome = 'created' OR a.num IS NOT NULL THEN a.num END,
          nullif(a.status, ''), CAST(n.n_nationkey AS VARCHAR), TIMESTAMP '2002-02-03 04:05:06', a."row", a.outcome = 'created'
        FROM applied a LEFT JOIN nation n ON n.n_name = a.nation_external_id
        WHERE a.outcome IN ('created', 'updated', 'deleted') AND a.k IS NOT NULL),
    numbered AS (SELECT *, count(*) FILTER (outcome IN ('base', 'created', 'deleted')) OVER (PARTITION BY k ORDER BY r) AS life FROM lives),
    final AS (SELECT *, max(life) OVER (PARTITION BY k) AS last_life FROM numbered),
    alive AS (SELECT k, arg_min(outcome, r) AS start, arg_max(name, r) AS name,
        CASE WHEN {replace} THEN (list(num ORDER BY r DESC))[1] ELSE arg_max(num, r) FILTER (num IS NOT NULL) END AS amount,
        CASE WHEN {replace} THEN (list(status ORDER BY r DESC))[1] ELSE arg_max(status, r) FILTER (status IS NOT NULL) END AS status,
        arg_max(nation_id, r) FILTER (nation_id IS NOT NULL) AS nation_id, arg_max(updated_at, r) AS updated_at
      FROM final WHERE life = last_life GROUP BY k HAVING arg_min(outcome, r) <> 'deleted'),
    merged AS (
      SELECT k AS external_id, 1 AS client_id, name, amount, status, nation_id, updated_at FROM alive
      UNION ALL SELECT external_id, client_id, name, amount, status, nation_id, updated_at FROM target
        WHERE client_id <> 1 OR external_id IS NULL
      UNION ALL SELECT a.external_id, 1, a.name, a.num, nullif(a.status, ''), CAST(n.n_nationkey AS VARCHAR), TIMESTAMP '2002-02-03 04:05:06'
        FROM applied a LEFT JOIN nation n ON n.n_name = a.nation_external_id WHERE a.outcome = 'created' AND a.k IS NULL)
    """


_MERGED = 'SELECT external_id, client_id, name, amount, status, nation_id, updated_at FROM merged'


def _rows(merged: M.Merge) -> DataFrame:
    return merged.table.select("external_id", "client_id", "name", "amount", "status", "nation_id", "updated_at")


@register("merge_actions", _sql() + _MERGED)
def merge_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An action per row, several rows per key."""
    return _rows(run(spark, sf_dir))


@register("merge_in_file_order", _sql() + 'SELECT "row", outcome, field, message FROM outcomes')
def merge_in_file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome of every row."""
    return run(spark, sf_dir, outcomes_only=True).outcomes


@register("merge_hot_keys", _sql() + 'SELECT "row", outcome, field, message FROM outcomes')
def merge_hot_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G4 with every key of more than 3 rows treated as hot: chunked, with the state carried over."""
    return run(spark, sf_dir, hot_rows=3, outcomes_only=True).outcomes


@register("merge_replace_overlay", _sql(overlay="replace") + _MERGED)
def merge_replace_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M10."""
    return _rows(run(spark, sf_dir, overlay="replace"))


@register("merge_create", _sql("create") + 'SELECT "row", outcome, field, message FROM outcomes')
def merge_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: all orders, of which each key's first one may create."""
    return run(spark, sf_dir, "create", action=False, outcomes_only=True).outcomes


@register("merge_unique_by_id", _sql("create") + 'SELECT "row", outcome FROM outcomes')
def merge_unique_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders create rows with ids of their own; whoever would take a held or already taken external id fails."""
    return run(spark, sf_dir, "create", action=False, match_key="id", outcomes_only=True).outcomes.select("row", "outcome")


@register("merge_update", _sql("update") + _MERGED)
def merge_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2."""
    return _rows(run(spark, sf_dir, "update", action=False))


@register("merge_upsert", _sql("upsert") + _MERGED)
def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: all orders, with no key promised to be cold or unique."""
    return _rows(run(spark, sf_dir, "upsert", action=False))


@register("merge_upsert_in_order", _sql("upsert") + _MERGED)
def merge_upsert_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(run(spark, sf_dir, "upsert", action=False))


@register(
    "merge_delete",
    _sql() + """SELECT external_id FROM target WHERE client_id = 1 AND external_id IS NOT NULL
                AND external_id NOT IN (SELECT external_id FROM merged WHERE external_id IS NOT NULL AND client_id = 1)""",
)
def merge_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: keys of the tenant that are gone after the merge."""
    before = accounts(spark, sf_dir).filter("client_id = 1 AND external_id IS NOT NULL").select("external_id")
    after = run(spark, sf_dir).table.filter("client_id = 1 AND external_id IS NOT NULL").select("external_id")
    return before.join(after, "external_id", "left_anti")


@register(
    "merge_outcome_counts",
    _sql() + """, c AS (SELECT count(*) FILTER (outcome = 'created') AS imported_count, count(*) FILTER (outcome = 'updated') AS updated_count,
       count(*) FILTER (outcome = 'deleted') AS deleted_count, count(*) FILTER (outcome = 'skipped') AS skipped_count,
       count(*) FILTER (outcome = 'failed') AS failed_count, count(*) AS total_rows FROM outcomes)
       SELECT *, CASE WHEN failed_count = 0 THEN 'succeeded' ELSE 'failed' END AS status,
         CASE WHEN failed_count > 0 THEN failed_count || ' records failed to import' END AS error_message FROM c""",
)
def merge_outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3, F9, F10, B8."""
    return M.run_status(M.outcome_counts(run(spark, sf_dir, outcomes_only=True).outcomes))


@register(
    "merge_duplicate_keys",
    """SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1""",
)
def merge_duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M19."""
    return M.duplicate_keys(Tables(spark, sf_dir)["line"], ["l_orderkey", "l_linenumber"])


@register(
    "merge_table_to_table",
    """SELECT coalesce(o.external_id, t.external_id) AS external_id, coalesce(o.name, t.name) AS name FROM
       (SELECT 'C' || c_custkey AS external_id, 'copy of ' || c_name AS name FROM customer) o
       FULL JOIN (SELECT CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 'C' || c_custkey END AS external_id, c_name AS name
                  FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 7 <> 0) t ON o.external_id = t.external_id
       UNION ALL SELECT CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 'C' || c_custkey END, c_name FROM customer
                  WHERE c_custkey % 3 <> 0 AND c_custkey % 7 = 0""",
)
def merge_table_to_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changeset is another table, not a file."""
    source = Tables(spark, sf_dir)["customer"].select(
        (F.col("c_custkey") + 1).alias("row"), F.concat(F.lit("C"), "c_custkey").alias("external_id"),
        F.concat(F.lit("copy of "), "c_name").alias("name"),
    )
    merged = M.merge(accounts(spark, sf_dir), source, account(), AS_OF, tenant=1, mode="upsert", unique_keys=True)
    return merged.table.select("external_id", "name")


@register(
    "merge_by_id",
    f"""WITH target AS (SELECT {', '.join(f'{d} AS "{n}"' for n, _, d in _TABLE)} FROM customer WHERE c_custkey % 3 <> 0),
        ch AS (SELECT 'id-' || o_custkey AS id, o_orderkey AS r, 'name ' || o_orderkey AS name, nullif(CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderstatus END, '') AS status
               FROM orders WHERE o_orderkey % 17 <> 0),
        last AS (SELECT id, arg_max(name, r) AS name, arg_max(status, r) FILTER (status IS NOT NULL) AS status FROM ch GROUP BY id)
        SELECT t.id, t.external_id, coalesce(l.name, t.name) AS name, coalesce(l.status, t.status) AS status
        FROM target t LEFT JOIN last l ON l.id = t.id AND t.client_id = 1""",
)
def merge_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row id as match key."""
    orders = Tables(spark, sf_dir)["order"]
    rows = orders.selectExpr(
        "o_orderkey + 1 AS row", "concat('id-', o_custkey) AS id",
        "CASE WHEN o_orderkey % 17 = 0 THEN ' ' ELSE concat('name ', o_orderkey) END AS name",
        "CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderstatus END AS status",
    )
    merged = M.merge(
        accounts(spark, sf_dir), rows, account(), AS_OF, tenant=1, mode="update", match_key="id", hold=keep
    )
    return merged.table.select("id", "external_id", "name", "status")
