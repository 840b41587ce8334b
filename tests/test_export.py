"""Filters, relations, sorting and paging over the five bills."""

from __future__ import annotations

from datetime import datetime

import pytest

from tallyferry.operators import paging
from tallyferry.plans.catalog import standard_registry
from tallyferry.plans.export import export, preview
from tallyferry.plans.specs import ExportSpec

REGISTRY = standard_registry()
AS_OF = datetime(2024, 1, 14, 9, 30)


def ids(bills, filters=None, **more):
    spec = ExportSpec.parse({"entity": "bill", "fields": ["id"], "filters": filters, **more})
    return [r.id[-1] for r in export(spec, bills, REGISTRY, "T1", AS_OF).rows.collect()]


def one(field, operator, value):
    return {"filters": [{"field": field, "operator": operator, "value": value}]}


@pytest.mark.parametrize(
    "where, want",
    [
        (one("status", "eq", "settled"), "25"),
        (one("status", "ne", "settled"), "134"),
        (one("description", "ne", "Annual database licence"), "134"),  # null is not "not equal"
        (one("amount", "gt", 1000), "235"),
        (one("amount", "gte", 1200.75), "235"),
        (one("amount", "lt", 310.4), "1"),
        (one("amount", "lte", "310.40"), "14"),
        (one("amount", "in", [80, 4100]), "13"),
        (one("amount", "between", [80, 1200.75]), "124"),
        (one("description", "contains", "copier"), "14"),
        (one("description", "startswith", "copier"), ""),
        (one("description", "startswith", "Copier"), "4"),
        (one("description", "endswith", "ledgers"), "3"),
        (one("description", "ilike", "%copier%"), ""),
        (one("amount", "contains", "00.0"), "3"),  # 80.0, 1200.75, 4100.0, 310.4, 56000000.5
        (one("amount", "startswith", "5600000"), "5"),
        (one("amount", "endswith", "0.4"), "4"),
        (one("date", "contains", "-12T08:00:00Z"), "3"),
        (one("vendor.name", "contains", "lindqvist"), "13"),
        (one("project.code", "eq", "KX-3"), "4"),
        ({"operator": "or", "filters": [
            {"field": "amount", "operator": "gt", "value": 2000}, {"field": "status", "operator": "eq", "value": "open"}]}, "135"),
        ({"operator": "not", "filters": [{"field": "description", "operator": "contains", "value": "copier"}]}, "235"),
        ({"operator": "not", "filters": [
            {"field": "status", "operator": "eq", "value": "settled"}, {"field": "amount", "operator": "lt", "value": 600}]}, "3"),
        ({"operator": "not", "groups": [{"operator": "not", "filters": [{"field": "vendor.name", "operator": "eq", "value": "x"}]}]}, ""),
        ({"operator": "or"}, ""),
        ({"operator": "and"}, "12345"),
        ({"operator": "not"}, "12345"),
        (one("amount", "eq", "many"), ""),
        (one("amount", "ne", "many"), "12345"),
        (one("amount", "eq", None), ""),
        (one("date", "between", ["2024-01-09", "soon"]), ""),
        (one("date", "gte", "relative:this_month"), "12345"),
        (one("date", "gte", "relative:last_7_days"), "12345"),
        (one("date", "between", ["relative:last_month", "2024-01-09T08:00:00Z"]), "14"),
        ({"date": {"gte": "2024-01-11", "lt": "2024-01-13"}}, "23"),
        ({"field": "status", "operator": "eq", "value": "late"}, "4"),
    ],
)
def test_filters(bills, where, want):
    assert "".join(sorted(ids(bills, where))) == want


def test_unknown_relative_date_is_refused(bills):
    with pytest.raises(ValueError, match="Unknown relative date"):
        ids(bills, one("date", "gte", "relative:someday"))


@pytest.mark.parametrize("path", ["vendor.phone", "vendor.project.name", "client_id", "nothing"])
def test_unknown_paths_are_refused(bills, path):
    with pytest.raises(ValueError, match="is not allowed for entity 'bill'"):
        ids(bills, one(path, "eq", 1))
    with pytest.raises(ValueError, match="is not allowed for entity 'bill'"):
        export(ExportSpec.parse({"entity": "bill", "fields": [path]}), bills, REGISTRY)


def test_aliases_order_and_repeated_fields(bills):
    spec = ExportSpec.parse({
        "entity": "bill", "sort": [{"field": "amount", "direction": "desc"}],
        "fields": [{"field": "vendor.name", "as": "Vendor"}, "id", {"field": "amount", "as": "A"}, {"field": "amount", "as": "B"}],
    })
    rows = export(spec, bills, REGISTRY, "T1", AS_OF).rows
    assert rows.columns == ["Vendor", "id", "A", "B"]
    assert [r.id for r in rows.collect()] == ["doc-5", "doc-3", "doc-2", "doc-4", "doc-1"]
    assert rows.head().Vendor is None


def test_nulls_last_ascending_and_first_descending(bills):
    assert ids(bills, sort=[{"field": "description"}])[-1] == "5"
    assert ids(bills, sort=[{"field": "description", "direction": "desc"}])[0] == "5"


def test_unknown_sort_field_is_ignored_with_a_warning(bills):
    with pytest.warns(UserWarning, match="unknown and ignored"):
        assert len(ids(bills, sort=[{"field": "colour"}])) == 5


@pytest.mark.parametrize("sort", [[{"field": "status"}], [{"field": "description", "direction": "desc"}], []])
def test_pages_are_disjoint_and_complete(bills, sort):
    pages = [ids(bills, sort=sort, limit=2, offset=o) for o in (0, 2, 4)]
    assert [len(p) for p in pages] == [2, 2, 1]
    assert len({i for p in pages for i in p}) == 5
    rest = ids(bills, sort=sort, offset=2)
    assert sorted(rest) == sorted(pages[1] + pages[2])


def test_offset_without_limit_keeps_the_order(bills):
    for direction in ("asc", "desc"):
        sort = [{"field": "description", "direction": direction}]
        assert ids(bills, sort=sort, offset=1) == ids(bills, sort=sort)[1:]
    assert ids(bills, sort=[{"field": "status"}], offset=9) == []


def test_default_order_only_for_slices(bills):
    assert ids(bills, limit=2) == ["5", "3"]


def test_keyset_walk_sees_every_row_once(bills):
    df = bills["bill"].select("id", "description")
    sort = [("description", "desc"), ("id", "asc")]
    seen, last = [], None
    while True:
        rest = df if last is None else paging.after_row(df, sort, last)
        page = paging.page_rows(rest, paging.sort_columns(sort), 2).collect()
        if not page:
            break
        seen += [r.id for r in page]
        last = [page[-1].description, page[-1].id]
    assert seen == [r.id for r in df.orderBy(*paging.sort_columns(sort)).collect()]


def test_count_ignores_the_slice(bills):
    spec = ExportSpec.parse({"entity": "bill", "fields": ["id"], "limit": 1, "offset": 1})
    plan = export(spec, bills, REGISTRY, "T1", AS_OF)
    assert plan.matched().head().matched == 5 and plan.rows.count() == 1


def test_limits(bills):
    for limit in (0, 100_001):
        with pytest.raises(ValueError, match="limit must be"):
            ExportSpec.parse({"entity": "bill", "fields": ["id"], "limit": limit})
    spec = ExportSpec.parse({"entity": "bill", "fields": ["id"]})
    with pytest.raises(ValueError, match="preview limit"):
        preview(spec, bills, REGISTRY, limit=101)


def test_unused_relations_are_not_joined_and_filters_reach_the_scan(spark, tmp_path, bills):
    stored = {}
    for name, df in bills.items():
        df.write.parquet(str(tmp_path / name))
        stored[name] = spark.read.parquet(str(tmp_path / name))
    spec = ExportSpec.parse({"entity": "bill", "fields": ["id"], "filters": {"filters": [
        {"field": "amount", "operator": "gt", "value": 700}, {"field": "date", "operator": "gte", "value": "2024-01-10"}]}})
    plan = export(spec, stored, REGISTRY, "T1", AS_OF).rows
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text
    assert "GreaterThan(amount,700.00)" in text and "GreaterThanOrEqual(date,2024-01-10T00:00)" in text
    assert "EqualTo(client_id,T1)" in text and "description" not in text


def test_a_hot_foreign_key_is_split_at_run_time(spark):
    """A third of all bills share one vendor; the shuffled join cuts that partition into several."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50KB", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        many = spark.range(200_000).selectExpr(
            "concat('b', id) AS id", "CASE WHEN id % 3 = 0 THEN 'v0' ELSE concat('v', id % 5000) END AS vendor_id", "md5(cast(id as string)) AS description"
        ).repartition(8)
        vendors = spark.range(5000).selectExpr("concat('v', id) AS id", "concat('name ', id) AS name")
        spec = ExportSpec.parse({"entity": "bill", "fields": ["id", "description", "vendor.name"]})
        rows = export(spec, {"bill": many, "vendor": vendors}, REGISTRY).rows
        assert rows.filter("`vendor.name` IS NOT NULL").count() == 200_000
        rows.collect()
        assert "skew=true" in rows._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_deep_offset_uses_the_sorted_keys(bills):
    sort = [("description", "desc"), ("id", "asc")]
    df = bills["bill"]
    want = [r.id for r in df.orderBy(*paging.sort_columns(sort)).collect()]
    for n in range(7):
        assert [r.id for r in paging.slice_rows(df, sort, n).collect()] == want[n:]
    for n, m in ((0, 3), (2, 0), (2, 1), (3, 9)):
        assert [r.id for r in paging.slice_rows(df, sort, n, m).collect()] == want[n : n + m]


def test_fields_without_a_stored_column_are_typed_nulls(spark):
    invoices = spark.createDataFrame([("i1", "T1", 5.0)], "id string, client_id string, total_amount double")
    spec = ExportSpec.parse({"entity": "invoice", "fields": ["id", "amount", "customer_id", "project.code"]})
    row = export(spec, {"invoice": invoices}, REGISTRY, "T1").rows.head()
    assert (row.id, row.amount, row.customer_id, row["project.code"]) == ("i1", 5.0, None, None)


def test_an_offset_keeps_rows_that_tie_with_the_edge(spark):
    df = spark.createDataFrame([(x,) for x in (1, 2, 2, 2, 3, None, None)], "x int")
    for sort, want in (([("x", "asc")], [1, 2, 2, 2, 3, None, None]), ([("x", "desc")], [None, None, 3, 2, 2, 2, 1])):
        for n in range(8):
            assert [r.x for r in paging.slice_rows(df, sort, n).collect()] == want[n:]
        for n, m in ((0, 2), (2, 1), (2, 4), (5, 1)):
            assert [r.x for r in paging.slice_rows(df, sort, n, m).collect()] == want[n : n + m]


def test_exports_come_back_as_they_went_out(spark, tmp_path):
    from tallyferry.sources.files import scan_file
    from tallyferry.sources.sinks import write_export

    rows = spark.createDataFrame([("  padded  ", 12345678.5, True, 1), ('say "x"\nnow', 0.001, False, 2), ("plain", 1e20, None, 3)], "a string, d double, b boolean, n int")
    rows = rows.selectExpr("*", "CAST(n * 10000000.50 AS DECIMAL(15,2)) AS m").repartition(3)
    for fmt in ("csv", "json"):
        path = str(tmp_path / f"out.{fmt}")
        assert write_export(rows, path, fmt) == 3
        back = scan_file(spark, path)
        assert sorted(r.a for r in back.collect()) == sorted(r.a for r in rows.collect())
    cells = {r.n: r for r in scan_file(spark, str(tmp_path / "out.csv")).collect()}
    assert (cells["1"].d, cells["1"].b, cells["1"].m) == ("12345678.5", "True", "10000000.5")
    assert (cells["2"].d, cells["3"].b, cells["3"].m) == ("0.001", None, "30000001.5")
