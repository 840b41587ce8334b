"""Export queries: filters, relations, sorting, paging, projection (2.C, 2.D, 2.E, 2.H)."""

from __future__ import annotations

from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyferry.functions.dates import iso_z, relative_age
from tallyferry.functions.ids import parse_uuid, stable_uuid
from tallyferry.functions.text import capitalise
from tallyferry.operators import filters, paging, relations
from tallyferry.plans.bindings import ORDER, star_registry
from tallyferry.plans.export import Export, export, preview
from tallyferry.plans.registry import ForeignKey
from tallyferry.plans.specs import ExportSpec, parse_filter
from tallyferry.sources.files import rename
from tallyferry.sources.tables import scan_entity, serialise, with_synonyms
from tallyferry.workload import Tables, register

REGISTRY = star_registry()
ORDERS_AS_OF = datetime(1998, 8, 15, 10, 30)
EVENTS_AS_OF = datetime(2024, 1, 20, 12, 0)


def run_spec(
    spark: SparkSession, sf_dir: str, raw: dict[str, Any], tenant: object = None, as_of: datetime = ORDERS_AS_OF
) -> Export:
    return export(ExportSpec.parse(raw, cap=None), Tables(spark, sf_dir), REGISTRY, tenant, as_of)


def _filtered(name: str, entity: str, fields: list[Any], where: Any, sql: str, **kw: Any) -> None:
    @register(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_spec(spark, sf_dir, {"entity": entity, "fields": fields, "filters": where}, **kw).rows


FLAGSHIP = {
    "entity": "order",
    "fields": [
        {"field": "id", "as": "order_id"},
        {"field": "amount", "as": "total"},
        {"field": "date", "as": "order_date"},
        {"field": "customer.name", "as": "customer_name"},
        {"field": "customer.segment", "as": "segment"},
    ],
    "filters": {
        "operator": "and",
        "filters": [
            {"field": "amount", "operator": "gt", "value": 100000},
            {"field": "customer.name", "operator": "contains", "value": "00"},
        ],
    },
    "sort": [{"field": "date", "direction": "desc"}],
    "limit": 1000,
}


@register(
    "export_flagship",
    """SELECT o_orderkey AS order_id, o_totalprice AS total, o_orderdate AS order_date,
              c_name AS customer_name, c_mktsegment AS segment
       FROM orders LEFT JOIN customer ON c_custkey = o_custkey
       WHERE o_totalprice > 100000 AND c_name LIKE '%00%' AND o_custkey % 4 = 1
       ORDER BY o_orderdate DESC, o_orderkey LIMIT 1000""",
)
def export_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_spec(spark, sf_dir, FLAGSHIP, tenant=1).rows


# -- filters ------------------------------------------------------------------------------------------

_ORDER_FIELDS = [{"field": "id", "as": "order_id"}, "amount"]
_ORDER_SQL = "SELECT o_orderkey AS order_id, o_totalprice AS amount FROM orders WHERE "
_NOTE = "(CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END)"


def _one(field: str, operator: str, value: Any) -> dict[str, Any]:
    return {"operator": "and", "filters": [{"field": field, "operator": operator, "value": value}]}


for _name, _where, _sql in (
    ("filter_eq", _one("status", "eq", "F"), "o_orderstatus = 'F'"),
    ("filter_ne", _one("note", "ne", "5-LOW"), f"{_NOTE} <> '5-LOW'"),
    ("filter_lt", _one("amount", "lt", 50000), "o_totalprice < 50000"),
    ("filter_lte", _one("date", "lte", "1996-03-01"), "o_orderdate <= TIMESTAMP '1996-03-01'"),
    ("filter_gt", _one("amount", "gt", 450000.5), "o_totalprice > 450000.5"),
    ("filter_gte", _one("date", "gte", "2001-01-01T00:00:00Z"), "o_orderdate >= TIMESTAMP '2001-01-01'"),
    ("filter_in", _one("priority", "in", ["1-URGENT", "2-HIGH"]), "o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    ("filter_between", _one("amount", "between", [100000, 120000]), "o_totalprice BETWEEN 100000 AND 120000"),
    ("filter_contains", _one("priority", "contains", "Med"), "contains(lower(o_orderpriority), 'med')"),
    ("filter_startswith", _one("priority", "startswith", "4-N"), "starts_with(o_orderpriority, '4-N')"),
    ("filter_endswith", _one("priority", "endswith", "HIGH"), "ends_with(o_orderpriority, 'HIGH')"),
    ("filter_ilike", _one("priority", "ilike", "urg"), "contains(lower(o_orderpriority), 'urg')"),
    # '%' is an ordinary character, so nothing matches.
    ("filter_literal_percent", _one("priority", "ilike", "%urg%"), "contains(lower(o_orderpriority), '%urg%')"),
    (
        "filter_and",
        {"filters": [
            {"field": "status", "operator": "eq", "value": "O"},
            {"field": "amount", "operator": "gte", "value": 250000},
            {"field": "date", "operator": "between", "value": ["1997-01-01", "1997-12-31"]},
        ]},
        "o_orderstatus = 'O' AND o_totalprice >= 250000 "
        "AND o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31'",
    ),
    (
        "filter_or",
        {"operator": "or", "filters": [
            {"field": "amount", "operator": "gt", "value": 490000},
            {"field": "note", "operator": "eq", "value": "1-URGENT"},
        ]},
        f"o_totalprice > 490000 OR {_NOTE} = '1-URGENT'",
    ),
    (
        "filter_not",
        {"operator": "not", "filters": [
            {"field": "status", "operator": "eq", "value": "F"},
            {"field": "amount", "operator": "lt", "value": 200000},
        ]},
        "NOT (o_orderstatus = 'F' OR o_totalprice < 200000)",
    ),
    (
        "filter_nested_groups",
        {"operator": "and",
         "filters": [{"field": "amount", "operator": "gt", "value": 100000}],
         "groups": [
             {"operator": "or",
              "filters": [{"field": "status", "operator": "eq", "value": "P"}],
              "groups": [{"operator": "not", "filters": [{"field": "note", "operator": "startswith", "value": "5"}]}]},
             {"operator": "or", "filters": [
                 {"field": "priority", "operator": "in", "value": ["1-URGENT", "5-LOW"]},
                 {"field": "date", "operator": "lt", "value": "1996-01-01"}]},
         ]},
        f"o_totalprice > 100000 AND (o_orderstatus = 'P' OR NOT coalesce(starts_with({_NOTE}, '5'), false)) "
        "AND (o_orderpriority IN ('1-URGENT', '5-LOW') OR o_orderdate < TIMESTAMP '1996-01-01')",
    ),
    ("filter_empty_and", {"operator": "and", "filters": []}, "true"),
    ("filter_empty_or", {"operator": "or", "filters": []}, "false"),
    ("filter_empty_not", {"operator": "not", "filters": []}, "true"),
    (
        "filter_null_not",
        {"operator": "not", "filters": [{"field": "note", "operator": "eq", "value": "5-LOW"}]},
        f"{_NOTE} IS NULL OR {_NOTE} <> '5-LOW'",
    ),
    (
        "filter_type_mismatch",
        {"operator": "and", "filters": [
            {"field": "rebate", "operator": "ne", "value": "not a number"}],
         "groups": [{"operator": "not", "filters": [{"field": "date", "operator": "gt", "value": "soon"}]}]},
        "o_orderkey % 5 <> 0",
    ),
    ("filter_map_form", {"amount": {"gte": 100000, "lte": 101000}}, "o_totalprice BETWEEN 100000 AND 101000"),
    ("filter_single_form", {"field": "status", "operator": "eq", "value": "P"}, "o_orderstatus = 'P'"),
    (
        "filter_date_text",
        _one("date", "contains", "1998-08-0"),
        "contains(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ'), '1998-08-0')",
    ),
):
    _filtered(_name, "order", _ORDER_FIELDS, _where, _ORDER_SQL + _sql)

_RELATIVE_SQL = {
    "last_7_days": "TIMESTAMP '1998-08-08 10:30:00'",
    "last_30_days": "TIMESTAMP '1998-07-16 10:30:00'",
    "last_90_days": "TIMESTAMP '1998-05-17 10:30:00'",
    "this_month": "date_trunc('month', TIMESTAMP '1998-08-15 10:30:00')",
    "last_month": "date_trunc('month', TIMESTAMP '1998-08-15 10:30:00') - INTERVAL 1 MONTH",
    "this_quarter": "date_trunc('quarter', TIMESTAMP '1998-08-15 10:30:00')",
    "last_quarter": "date_trunc('quarter', TIMESTAMP '1998-08-15 10:30:00') - INTERVAL 3 MONTH",
    "this_year": "date_trunc('year', TIMESTAMP '1998-08-15 10:30:00')",
    "last_year": "date_trunc('year', TIMESTAMP '1998-08-15 10:30:00') - INTERVAL 1 YEAR",
}
for _name, _sql in _RELATIVE_SQL.items():
    _filtered(
        f"filter_relative_{_name}", "order", _ORDER_FIELDS,
        _one("date", "gte", f"relative:{_name}"), f"{_ORDER_SQL} o_orderdate >= {_sql}",
    )
_filtered(
    "filter_relative_between", "order", _ORDER_FIELDS,
    _one("date", "between", ["relative:last_month", "relative:this_month"]),
    f"{_ORDER_SQL} o_orderdate BETWEEN TIMESTAMP '1998-07-01' AND TIMESTAMP '1998-08-01'",
)
_filtered(
    "filter_relation_path", "order", [{"field": "id", "as": "order_id"}, {"field": "customer.segment", "as": "segment"}],
    {"filters": [
        {"field": "customer.segment", "operator": "eq", "value": "BUILDING"},
        {"field": "customer.balance", "operator": "gt", "value": 5000},
    ]},
    """SELECT o_orderkey AS order_id, c_mktsegment AS segment FROM orders JOIN customer ON c_custkey = o_custkey
       WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000""",
)
_filtered(
    "filter_json_path", "event", [{"field": "id", "as": "event_id"}, "k"], _one("k", "eq", "42"),
    "SELECT event_id, props ->> '$.k' AS k FROM events WHERE props ->> '$.k' = '42'", as_of=EVENTS_AS_OF,
)
_filtered(
    "filter_tenant", "order", _ORDER_FIELDS, None, _ORDER_SQL + "o_custkey % 4 = 2", tenant=2,
)
_filtered(
    "filter_date_range", "event", [{"field": "id", "as": "event_id"}, "ts"],
    {"filters": [
        {"field": "ts", "operator": "gte", "value": "2024-01-10T00:00:00+02:00"},
        {"field": "ts", "operator": "lte", "value": "2024-01-12T06:30:00Z"},
    ]},
    """SELECT event_id, ts FROM events
       WHERE ts >= TIMESTAMP '2024-01-09 22:00:00' AND ts <= TIMESTAMP '2024-01-12 06:30:00'""",
    as_of=EVENTS_AS_OF,
)


@register(
    "filter_text_timestamp",
    "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-13 12:00:00'",
)
def filter_text_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text field holding ISO stamps against a date value."""
    events = Tables(spark, sf_dir)["event"].select("event_id", iso_z(F.col("ts")).alias("stamp"))
    where = parse_filter(_one("stamp", "gte", "relative:last_7_days"))
    return events.filter(filters.as_filter(where, filters.frame_resolver(events), EVENTS_AS_OF)).select("event_id")


@register(
    "filter_as_boolean",
    f"SELECT o_orderkey AS order_id, coalesce({_NOTE} <> '5-LOW', false) AS hit FROM orders",
)
def filter_as_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1-D15 as a projected flag: two-valued, so never null."""
    orders = scan_entity(Tables(spark, sf_dir)["order"], ORDER)
    where = parse_filter(_one("note", "ne", "5-LOW"))
    hit = filters.as_boolean(where, filters.frame_resolver(orders), ORDERS_AS_OF)
    return orders.select(F.col("id").alias("order_id"), hit.alias("hit"))


# -- relations ----------------------------------------------------------------------------------------


@register(
    "join_one_relation",
    """SELECT o_orderkey AS id, o_totalprice AS amount, c_name AS "customer.name", c_acctbal AS "customer.balance"
       FROM orders LEFT JOIN customer ON c_custkey = o_custkey""",
)
def join_one_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["id", "amount", "customer.name", "customer.balance"]
    return run_spec(spark, sf_dir, {"entity": "order", "fields": fields}).rows


@register(
    "join_three_relations",
    """SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_extendedprice AS amount,
              o_orderpriority AS priority, p_name AS part_name, s_name AS supplier_name
       FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN part ON p_partkey = l_partkey
       LEFT JOIN supplier ON s_suppkey = l_suppkey
       WHERE l_quantity >= 10 AND p_brand = 'Brand#17'""",
)
def join_three_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = {
        "entity": "line",
        "fields": [
            "order_id", "line_no", "amount",
            {"field": "order.priority", "as": "priority"},
            {"field": "part.name", "as": "part_name"},
            {"field": "supplier.name", "as": "supplier_name"},
        ],
        "filters": {"filters": [
            {"field": "quantity", "operator": "gte", "value": 10},
            {"field": "part.brand", "operator": "eq", "value": "Brand#17"},
        ]},
    }
    return run_spec(spark, sf_dir, raw).rows


@register(
    "join_missing_dimension_rows",
    """SELECT d.doc_id AS id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def join_missing_dimension_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relation that matches nothing gives nulls; only some documents have a label."""
    fields = ["id", "lang", {"field": "label.quality", "as": "quality"}, {"field": "label.toxic", "as": "toxic"}]
    return run_spec(spark, sf_dir, {"entity": "document", "fields": fields}).rows


@register(
    "join_nested_record",
    """SELECT c_custkey AS id, n_name AS nation_name, n_name IS NOT NULL AS has_nation
       FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 5 <> 0""",
)
def join_nested_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Related rows as structs, null where nothing matches."""
    tables = Tables(spark, sf_dir)
    entity = REGISTRY.get("customer")
    used = {"nation": ["id", "name"]}
    flat = relations.attach_relations(
        scan_entity(tables["customer"], entity, relations=used), entity, used,
        {"nation": tables["nation"].filter("n_nationkey % 5 <> 0")}, REGISTRY,
    )
    nested = relations.nest_relations(flat, used)
    return nested.select("id", F.col("nation.name").alias("nation_name"), F.col("nation").isNotNull().alias("has_nation"))


@register(
    "join_fk_resolution",
    """SELECT o_orderkey AS order_id,
              CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_custkey
                        WHEN o_orderkey % 3 = 1 THEN c_custkey END AS VARCHAR) AS customer_id
       FROM orders LEFT JOIN customer
         ON c_name = 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AND c_custkey % 4 = 1""",
)
def join_fk_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the orders give an id, a third an external id, a third nothing that resolves."""
    tables = Tables(spark, sf_dir)
    rows = tables["order"].select(
        F.col("o_orderkey").alias("order_id"),
        F.expr("CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS STRING) ELSE '' END").alias("given_id"),
        F.expr(
            "CASE WHEN o_orderkey % 3 = 1 THEN concat('Customer#', lpad(CAST(o_custkey AS STRING), 9, '0')) "
            "WHEN o_orderkey % 3 = 2 THEN 'nobody' END"
        ).alias("customer_external_id"),
    )
    customers = {"customer": tables["customer"].withColumn("external_id", F.col("c_name"))}
    key = ForeignKey("given_id", "customer", external="customer_external_id")
    found = relations.resolve_foreign_key(rows, key, customers, REGISTRY, 1, "customer_id")
    return found.select("order_id", "customer_id")


def _asked_keys(tables: Tables) -> DataFrame:
    """Every order asks for a customer; one in five asks for a customer number that does not exist."""
    return tables["order"].select(
        "o_orderkey", F.expr("CASE WHEN o_orderkey % 5 = 0 THEN -o_custkey - 1 ELSE o_custkey END").alias("c_custkey")
    )


_ASKED = "(SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN -o_custkey - 1 ELSE o_custkey END AS c_custkey FROM orders)"


@register("lookup_existing", f"SELECT * FROM {_ASKED} WHERE c_custkey IN (SELECT c_custkey FROM customer)")
def lookup_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables(spark, sf_dir)
    return relations.existing(_asked_keys(tables), tables["customer"], ["c_custkey"])


@register("lookup_missing", f"SELECT * FROM {_ASKED} WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)")
def lookup_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables(spark, sf_dir)
    return relations.missing(_asked_keys(tables), tables["customer"], ["c_custkey"])


@register(
    "cascade_delete",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
       WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""",
)
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of deleted orders go with them."""
    tables = Tables(spark, sf_dir)
    lines = tables["line"].select("l_orderkey", "l_linenumber", "l_partkey")
    deleted = tables["order"].filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return relations.cascade_delete(lines, deleted, "l_orderkey")


# -- sorting and paging ---------------------------------------------------------------------------------

_REBATE = "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END"


def _sliced(name: str, raw: dict[str, Any], sql: str) -> None:
    @register(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_spec(spark, sf_dir, raw).rows


_sliced(
    "sort_asc_nulls",
    {"entity": "order", "fields": ["id", "rebate"], "sort": [{"field": "rebate"}], "offset": 11000, "limit": 3000},
    f"SELECT o_orderkey AS id, {_REBATE} AS rebate FROM orders ORDER BY 2 ASC NULLS LAST, 1 LIMIT 3000 OFFSET 11000",
)
_sliced(
    "sort_desc_nulls",
    {"entity": "order", "fields": ["id", "rebate"], "sort": [{"field": "rebate", "direction": "desc"}], "limit": 3500},
    f"SELECT o_orderkey AS id, {_REBATE} AS rebate FROM orders ORDER BY 2 DESC NULLS FIRST, 1 LIMIT 3500",
)
_sliced(
    "sort_mixed",
    {"entity": "order", "fields": ["id", "priority", "amount"], "limit": 2000,
     "sort": [{"field": "priority", "direction": "desc"}, {"field": "amount", "direction": "asc"}]},
    """SELECT o_orderkey AS id, o_orderpriority AS priority, o_totalprice AS amount FROM orders
       ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey LIMIT 2000""",
)
_sliced(
    "sort_relation_path",
    {"entity": "order", "fields": ["id", {"field": "customer.name", "as": "customer_name"}], "limit": 500,
     "sort": [{"field": "customer.name", "direction": "desc"}]},
    """SELECT o_orderkey AS id, c_name AS customer_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey
       ORDER BY c_name DESC NULLS FIRST, o_orderkey LIMIT 500""",
)
_sliced(
    "sort_default_order",
    {"entity": "order", "fields": ["id", "date"], "limit": 100},
    "SELECT o_orderkey AS id, o_orderdate AS date FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100",
)
_sliced(
    "page_n",
    {"entity": "part", "fields": ["id", "name", "price"], "sort": [{"field": "name"}], "offset": 500, "limit": 250},
    """SELECT p_partkey AS id, p_name AS name, p_retailprice AS price FROM part
       ORDER BY p_name, p_partkey LIMIT 250 OFFSET 500""",
)
_sliced(
    "page_offset_only",
    {"entity": "order", "fields": ["id", "rebate"], "sort": [{"field": "rebate"}], "offset": 9000},
    f"SELECT o_orderkey AS id, {_REBATE} AS rebate FROM orders ORDER BY 2 ASC NULLS LAST, 1 OFFSET 9000",
)
_sliced(
    "export_all_sorted",
    {"entity": "line", "fields": ["order_id", "line_no", "flag", "amount"],
     "sort": [{"field": "flag"}, {"field": "amount", "direction": "desc"}]},
    "SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_returnflag AS flag, l_extendedprice AS amount FROM lineitem",
)


@register(
    "page_large_slice",
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER
         (ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS n FROM lineitem)
       SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_extendedprice AS amount FROM s WHERE n > 3000 AND n <= 3000 + 30000""",
)
def page_large_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H6 with a limit that no task should hold."""
    line = REGISTRY.get("line")
    rows = scan_entity(Tables(spark, sf_dir)["line"], line)
    sort = [("date", "desc"), *[(name, "asc") for name in line.unique_sort if name != "date"]]
    return paging.slice_rows(rows, sort, 3_000, 30_000).select("order_id", "line_no", "amount")


@register(
    "page_deep_offset",
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, row_number() OVER
         (ORDER BY l_returnflag DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) AS n FROM lineitem)
       SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_extendedprice AS amount FROM s WHERE n > 40000""",
)
def page_deep_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H6: the edge row is found by its place in the sorted ranges of the keys."""
    line = REGISTRY.get("line")
    rows = scan_entity(Tables(spark, sf_dir)["line"], line)
    sort = [("flag", "desc"), *[(name, "asc") for name in line.unique_sort]]
    return paging.slice_rows(rows, sort, 40_000).select("order_id", "line_no", "amount")


@register(
    "preview_topk",
    """SELECT o_orderkey AS id, o_totalprice AS amount FROM orders WHERE o_orderstatus = 'O'
       ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""",
)
def preview_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = ExportSpec.parse({
        "entity": "order", "fields": ["id", "amount"], "filters": _one("status", "eq", "O"),
        "sort": [{"field": "amount", "direction": "desc"}],
    })
    return preview(spec, Tables(spark, sf_dir), REGISTRY).rows


@register(
    "keyset_page",
    """WITH s AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders)
       SELECT o_orderkey AS id, o_totalprice AS amount FROM s WHERE n > 1000 AND n <= 1500""",
)
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page after row 1000, reached by a filter on its sort values."""
    orders = scan_entity(Tables(spark, sf_dir)["order"], ORDER).select("id", "amount")
    sort = [("amount", "desc"), ("id", "asc")]
    order = paging.sort_columns(sort)
    last = orders.orderBy(*order).offset(999).limit(1).head()
    rest = paging.after_row(orders, sort, [last["amount"], last["id"]])
    return paging.page_rows(rest, order, 500)


@register(
    "count_matched",
    """SELECT count(*) AS matched FROM lineitem LEFT JOIN part ON p_partkey = l_partkey
       WHERE l_discount BETWEEN 0.02 AND 0.06 AND contains(lower(p_name), 'ring')""",
)
def count_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_spec(spark, sf_dir, {
        "entity": "line", "fields": ["order_id"],
        "filters": {"filters": [
            {"field": "discount", "operator": "between", "value": [0.02, 0.06]},
            {"field": "part.name", "operator": "contains", "value": "RING"},
        ]},
    }).matched()


@register(
    "count_pages",
    "SELECT count(*) AS total, CAST(ceil(count(*) / 50) AS BIGINT) AS total_pages FROM orders WHERE o_orderstatus = 'P'",
)
def count_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.page_totals(Tables(spark, sf_dir)["order"].filter("o_orderstatus = 'P'"), 50)


@register(
    "page_number",
    "SELECT c_custkey AS id, c_name AS name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50 OFFSET 100",
)
def page_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = scan_entity(Tables(spark, sf_dir)["customer"], REGISTRY.get("customer"))
    order = paging.sort_columns([("balance", "desc")], ["id"])
    return paging.page_number(customers, order, 3, 50).select("id", "name")


# -- projection -----------------------------------------------------------------------------------------


@register(
    "serialize_iso",
    """SELECT event_id, CASE WHEN date_part('microseconds', ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
                             ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') END AS ts,
              CAST(CAST(value AS DECIMAL(15,2)) AS DOUBLE) AS amount
       FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN date_trunc('second', ts) ELSE ts END AS ts, value FROM events)""",
)
def serialize_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = Tables(spark, sf_dir)["event"]
    return serialise(events.select(
        "event_id",
        F.expr("CASE WHEN event_id % 2 = 0 THEN CAST(date_trunc('second', ts) AS TIMESTAMP_NTZ) ELSE ts END").alias("ts"),
        F.col("value").cast("decimal(15,2)").alias("amount"),
    ))


@register(
    "synonyms",
    """SELECT c_custkey AS id, c_name AS email_address, c_acctbal AS total_amount, c_name AS email, c_acctbal AS amount
       FROM customer""",
)
def synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = Tables(spark, sf_dir)["customer"]
    return with_synonyms(customers.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("email_address"), F.col("c_acctbal").alias("total_amount"),
    ))


@register(
    "rename_columns",
    """SELECT o_orderkey AS id, o_orderstatus AS state, o_totalprice AS amount, o_orderdate, o_orderpriority AS code
       FROM orders""",
)
def rename_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns are mapped to `code`; the later one wins."""
    return rename(Tables(spark, sf_dir)["order"], {
        "o_orderkey": "id", "o_custkey": "code", "o_orderstatus": "state", "o_totalprice": "amount",
        "o_orderpriority": "code",
    })


@register(
    "relative_age",
    """WITH e AS (SELECT event_id, ts, floor(date_diff('microsecond', ts, TIMESTAMP '2024-01-20 12:00:00') / 1000000) AS s FROM events),
       a AS (SELECT *, CAST(floor(s / 60) AS BIGINT) AS m, CAST(floor(s / 3600) AS BIGINT) AS h, CAST(floor(s / 86400) AS BIGINT) AS d FROM e)
       SELECT event_id, CASE WHEN s < 60 THEN 'just now'
         WHEN s < 3600 THEN m || ' minute' || CASE WHEN m = 1 THEN '' ELSE 's' END || ' ago'
         WHEN s < 86400 THEN h || ' hour' || CASE WHEN h = 1 THEN '' ELSE 's' END || ' ago'
         WHEN s < 604800 THEN d || ' day' || CASE WHEN d = 1 THEN '' ELSE 's' END || ' ago'
         ELSE strftime(ts, '%-m/%-d/%Y') END AS age FROM a""",
)
def relative_age_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir)["event"].select("event_id", relative_age(F.col("ts"), EVENTS_AS_OF).alias("age"))


@register(
    "capitalise",
    "SELECT p_partkey, upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS name FROM part",
)
def capitalise_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir)["part"].select("p_partkey", capitalise(F.col("p_name")).alias("name"))


@register(
    "stable_ids",
    """WITH h AS (SELECT o_orderkey, md5('t' || chr(1) || 'order' || chr(1) || o_orderkey) AS h FROM orders)
       SELECT o_orderkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21) AS id FROM h""",
)
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that come out the same on every run."""
    orders = Tables(spark, sf_dir)["order"]
    return orders.select("o_orderkey", stable_uuid(F.lit("t"), F.lit("order"), F.col("o_orderkey")).alias("id"))


@register(
    "parse_uuids",
    """WITH h AS (SELECT o_orderkey, md5(CAST(o_orderkey AS VARCHAR)) AS h FROM orders)
       SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 2 THEN
         substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21) END AS id FROM h""",
)
def parse_uuids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare, upper-case in braces, and cut short."""
    raw = F.expr(
        "CASE o_orderkey % 3 WHEN 0 THEN md5(CAST(o_orderkey AS STRING)) "
        "WHEN 1 THEN concat('{', upper(md5(CAST(o_orderkey AS STRING))), '}') ELSE left(md5(CAST(o_orderkey AS STRING)), 20) END"
    )
    return Tables(spark, sf_dir)["order"].select("o_orderkey", parse_uuid(raw).alias("id"))
