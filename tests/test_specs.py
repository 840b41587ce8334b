from __future__ import annotations

from datetime import datetime

import pytest

from tallyferry.functions.dates import resolve_relative
from tallyferry.plans.catalog import BILL, standard_registry
from tallyferry.plans.registry import EntityDef, FieldDef, Registry
from tallyferry.plans.specs import Group, ImportSpec, Where, auto_map, check_job, parse_filter, parse_literal
from tallyferry.sources.files import content_type, file_suffix


def test_registry_lists_joins_and_fields():
    registry = standard_registry()
    assert len(registry.joins()) == 5
    assert registry.joins()[("invoice", "vendor")] == ("vendor", "contact_id")
    assert "vendor.email" in BILL.allowed_paths() and "vendor.phone" not in BILL.allowed_paths()
    assert {"entity": "bill", "path": "project.code", "type": "string", "label": "Project Code", "required": False} in registry.listing()
    assert BILL.struct_type()["amount"].metadata == {"label": "Amount", "required": True}


def test_register_an_entity_and_detect_mismatch():
    registry = Registry()
    registry.register(EntityDef("ship", "Ships", (FieldDef("id"), FieldDef("name"))))
    assert registry.get("ship").label == "Ships"
    with pytest.raises(ValueError, match="not registered"):
        registry.check_names(["ship", "boat"])
    with pytest.raises(KeyError):
        registry.get("boat")
    with pytest.raises(ValueError, match="Unknown field type"):
        FieldDef("x", "colour")


def test_default_fields():
    fields = BILL.default_fields()
    assert fields[0] == {"field": "id", "as": "ID", "selected": True}
    assert {"field": "vendor.name", "as": "Vendor Vendor Name", "selected": False} in fields


def test_auto_map():
    assert auto_map(["Due_Date", "AMOUNT", "External ID", "colour"], BILL) == {
        "Due_Date": "due_date", "AMOUNT": "amount", "External ID": "external_id",
    }


def test_filter_forms():
    leaf = Where("a", "eq", 1)
    assert parse_filter({"field": "a", "operator": "eq", "value": 1}) == Group("and", (leaf,))
    assert parse_filter({"a": 1}) == Group("and", (leaf,))
    assert parse_filter({"a": {"gte": 1, "lte": 2}}) == Group("and", (Where("a", "gte", 1), Where("a", "lte", 2)))
    assert parse_filter(None) is None
    for bad in ({"field": "a", "operator": "starts_with", "value": 1}, {"field": "a", "operator": "between", "value": [1]},
                {"field": "a", "operator": "in", "value": "x"}, {"operator": "xor", "filters": []}):
        with pytest.raises(ValueError):
            parse_filter(bad)


def test_jobs_and_literals():
    check_job("export", {"entity": "bill"}, None)
    with pytest.raises(ValueError, match="import_config"):
        check_job("import", {"entity": "bill"}, None)
    assert [parse_literal(v) for v in ("12", "1.5", "x")] == [12, 1.5, "x"]
    with pytest.raises(ValueError, match="import mode"):
        ImportSpec("bill", mode="replace")
    spec = ImportSpec.parse({"entity": "bill", "import_mode": "upsert", "fields": [{"source": "Total", "target": "amount"}]})
    assert (spec.mode, spec.mappings, spec.match_key) == ("upsert", {"Total": "amount"}, "external_id")
    assert file_suffix("JSON") == ".json" and file_suffix("pdf") == ".csv" and content_type("csv") == "text/csv"


@pytest.mark.parametrize(
    "name, want",
    [
        ("last_7_days", datetime(2024, 1, 8, 13, 5)), ("this_month", datetime(2024, 1, 1)), ("last_month", datetime(2023, 12, 1)),
        ("this_quarter", datetime(2024, 1, 1)), ("last_quarter", datetime(2023, 10, 1)), ("this_year", datetime(2024, 1, 1)),
        ("last_year", datetime(2023, 1, 1)), ("last_90_days", datetime(2023, 10, 17, 13, 5)),
    ],
)
def test_relative_dates(name, want):
    assert resolve_relative(f"relative:{name}", datetime(2024, 1, 15, 13, 5)) == want
