from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyferry.functions.rules import RowRule
from tallyferry.operators import validation
from tallyferry.plans.catalog import BILL, PROJECT
from tallyferry.plans.registry import EntityDef, FieldDef
from tallyferry.sources.files import number_rows, scan_csv


def messages(df, entity=BILL, **kw):
    checked = validation.validate(df, entity, **kw)
    return {r.row: [(e.field, e.message) for e in r.errors] for r in checked.collect()}


def frame(spark, columns, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], "row long, " + ", ".join(f"`{c}` string" for c in columns))


def test_cells(spark):
    df = frame(spark, ["amount", "date", "due_date", "description"], [
        ("1500.00", "2024-02-01", "2024-03-01", "Union Pacific Railroad, Select Staffing Services"),
        ("-100.00", "2024-01-15", None, None),
        ("0", "2024-01-15", None, None),
        ("5", "2024-01-15", "2024-01-01", None),
        ("-50.00", "2024-01-15", "2024-1-1", None),
        ("not_a_number", "2024-01-15", None, None),
        ("   ", "2024-01-15", None, None),
        ("5", "15/01/2024", "2020-01-01", None),
        ("5", "2024-13-45", None, "'; DROP TABLE bills; --"),
        ("5", "2024-01-15", None, "<SCRIPT>alert(1)</script> /* x */"),
        ("nan", "2024-01-15", None, None),
        (None, None, None, "fine"),
        ("5", "2024-01-15", "';", "-"),
    ])
    positive, before = ("amount", "Amount must be greater than zero"), ("due_date", "Due date cannot be before the bill date")
    number = ("amount", "Field 'amount' must be a number")
    assert messages(df) == {
        1: [], 2: [positive], 3: [positive], 4: [before], 5: [positive, before], 6: [number],
        7: [("amount", "Required field 'amount' is missing or empty"), number],
        8: [("date", "Field 'date' must be in YYYY-MM-DD format")],
        9: [("description", "Potentially malicious content detected in field 'description'")],
        10: [("description", "Potentially malicious content detected in field 'description'"),
             ("description", "Potentially malicious script content in field 'description'")],
        11: [],
        12: [("amount", "Required field 'amount' is missing or empty"), ("date", "Required field 'date' is missing or empty")],
        13: [("due_date", "Potentially malicious content detected in field 'due_date'")],
    }
    strict = messages(df, strict=True)
    assert strict[11] == [number]
    assert strict[9][0] == ("date", "Field 'date' must be in YYYY-MM-DD format")


def test_markers_never_span_two_cells(spark):
    df = frame(spark, ["code", "name", "description"], [("a-", "-b", "it's '"), ("x", "y", "; z")])
    assert messages(df, PROJECT) == {1: [], 2: []}


def test_typed_json_cells_skip_text_rules(spark):
    df = spark.createDataFrame([(1, 5.5, "2024-01-01"), (2, -1.0, "2024-01-01")], "row long, amount double, date string")
    assert messages(df) == {1: [], 2: [("amount", "Amount must be greater than zero")]}
    odd = spark.createDataFrame([(1, ["5"], "2024-01-01")], "row long, amount array<string>, date string")
    assert messages(odd.withColumn("row", F.col("row")), EntityDef("e", "E", (FieldDef("id"),)))[1] == [
        ("amount", "Field 'amount' must be a number")
    ]


def test_actions(spark):
    df = frame(spark, ["_action", "external_id", "amount", "date"], [
        ("C", "a", "5", "2024-01-01"), (" delete ", None, None, None), ("D", "b", None, None),
        ("merge", "c", None, None), ("", "d", "x", "2024-01-01"), (None, "e", "5", "2024-01-01"), ("i", "f", None, "2024-01-01"),
    ])
    found = messages(df)
    assert found[1] == [] and found[3] == [] and found[6] == []
    assert found[2] == [("external_id", "external_id is required for DELETE action")]
    assert found[4] == [("_action", "Invalid action 'merge'. Use CREATE/C, UPDATE/U, UPSERT/X, or DELETE/D")]
    assert found[5] == [("amount", "Field 'amount' must be a number")]
    shown = {r.row: r for r in validation.preview(df, BILL).collect()}
    assert [e.message for e in shown[5].errors] == [
        "Field 'amount' must be a number", "Action is required when _action column is present"]
    assert [e.field for e in shown[4].errors] == ["amount", "date", "_action"]
    assert (shown[1].action, shown[2].action, shown[4].action) == ("create", "delete", None)
    assert shown[1].is_valid and not shown[6].is_valid and shown[3].data.external_id == "b"


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,amount,date,description,status\n,10,2024-02-01,x,paid\n,,2024-01-15,no amount,paid\n\n")
    (tmp_path / "b.csv").write_text("id,description\n,x\n")
    (tmp_path / "c.csv").write_text("id,amount,date\n")
    a = validation.validate(number_rows(scan_csv(spark, str(tmp_path / "a.csv")), per_file=False), BILL)
    assert validation.summary(a).head().asDict() == {"total": 2, "valid": 1, "invalid": 1, "error_count": 1}
    b = scan_csv(spark, str(tmp_path / "b.csv"))
    header = validation.header_errors(b.columns, BILL)
    assert header == [{"row": 0, "field": None, "message": "Missing required fields: amount, date"}]
    checked = validation.validate(number_rows(b, per_file=False), BILL)
    assert validation.summary(checked, len(header)).head().asDict() == {"total": 1, "valid": 1, "invalid": 1, "error_count": 1}
    c = validation.validate(number_rows(scan_csv(spark, str(tmp_path / "c.csv")), per_file=False), BILL)
    assert validation.summary(c).head().asDict() == {"total": 0, "valid": 0, "invalid": 1, "error_count": 1}
    assert validation.header_errors([], BILL)[0]["message"] == "CSV file has no header row"
    assert validation.header_errors(["_action", "external_id"], BILL) == []


@pytest.mark.parametrize("bad, abort_rows", [(True, 0), (False, 2)])
def test_split(spark, bad, abort_rows):
    df = frame(spark, ["amount", "date"], [("5", "2024-01-01"), ("-5" if bad else "6", "2024-01-01")])
    checked = validation.validate(df, BILL)
    assert validation.split(checked, "abort")[0].count() == abort_rows
    assert validation.split(checked, "skip")[0].count() == (1 if bad else 2)


def test_own_rule_and_missing_inputs(spark):
    rule = RowRule("name", "Name must not be Bob", ("name",), lambda c: c["name"] == "Bob")
    other = RowRule("size", "never", ("size",), lambda c: c["size"] == "x")
    entity = EntityDef("person", "People", (FieldDef("id"), FieldDef("name")), rules=(rule, other))
    assert messages(frame(spark, ["name"], [("Bob",), ("Eve",)]), entity) == {1: [("name", "Name must not be Bob")], 2: []}
