"""The merge against a plain sequential loop, and the import scenarios with known counts."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql.types import DoubleType

from tallyferry.operators import merge as M, numbering
from tallyferry.operators.uniqueness import refused_claims
from tallyferry.plans.catalog import BILL, INVOICE, PROJECT, VENDOR, standard_registry
from tallyferry.plans.imports import run_import
from tallyferry.plans.registry import EntityDef, FieldDef, MergeColumn
from tallyferry.plans.specs import ImportSpec
from tallyferry.session import keep

AS_OF = datetime(2025, 2, 1, 12)
OLD = datetime(2020, 1, 1)
THING_SCHEMA = "id string, client_id string, external_id string, name string, amount double, created_at timestamp_ntz, updated_at timestamp_ntz"


def thing(overlay):
    return EntityDef(
        "thing", "Things", (FieldDef("id"), FieldDef("external_id"), FieldDef("name")), required=("name",), overlay=overlay,
        merge_columns=(
            MergeColumn("external_id"), MergeColumn("name"), MergeColumn("amount", type="number", data_type=DoubleType()),
        ),
    )


def sequential(table, changes, key, overlay):
    """table: list of dicts (tenant T only); returns outcomes and the rows afterwards."""
    rows, outcomes = [dict(r) for r in table], {}
    words = {"C": "create", "U": "update", "X": "upsert", "D": "delete"}
    for c in changes:
        action, value = words.get(c["_action"]), c[key]
        hit = next((r for r in rows if value and r[key] == value), None)
        if action is None or (action in ("delete", "update") and not value) or (action != "delete" and not (c["name"] or "").strip()):
            outcome = "failed"
        elif action == "delete":
            outcome = "deleted" if hit else "skipped"
        elif action == "create":
            outcome = "failed" if hit else "created"
        elif action == "update":
            outcome = "updated" if hit else "skipped"
        else:
            outcome = "updated" if hit else "created"
        if outcome in ("created", "updated") and c["amount"] == "bad":
            outcome = "failed"
        if outcome in ("created", "updated") and c["external_id"] and any(r["external_id"] == c["external_id"] for r in rows if r is not hit):
            outcome = "failed"
        if outcome == "deleted":
            rows.remove(hit)
        elif outcome == "created":
            rows.append({"id": None, "external_id": c["external_id"], "name": c["name"], "amount": c["amount"] and float(c["amount"])})
        elif outcome == "updated":
            for f in ("external_id", "name", "amount"):
                if f != key and (overlay == "replace" or c[f] not in (None, "")):
                    hit[f] = float(c[f]) if f == "amount" and c[f] else c[f]
        outcomes[c["row"]] = outcome
    return outcomes, rows


@pytest.mark.parametrize(
    "key, overlay, hot_rows, seed",
    [("external_id", "keep", 1_000_000, 1), ("external_id", "replace", 5, 2), ("external_id", "keep", 3, 3), ("id", "keep", 4, 4), ("external_id", "keep", None, 5)],
)
def test_random_merge_equals_a_sequential_loop(spark, key, overlay, hot_rows, seed):
    rng = random.Random(seed)
    keys = [f"k{i}" for i in range(30)]
    table = [{"id": f"i{k}", "external_id": k, "name": f"old {k}", "amount": 1.0} for k in keys[:15]]
    values = [f"i{k}" for k in keys] if key == "id" else keys
    changes = []
    for n in range(1, 601):
        value = values[0] if rng.random() < 0.33 else rng.choice(values)  # one key holds a third of all rows
        value = None if rng.random() < 0.05 else value
        changes.append({
            "row": n, "_action": rng.choice("CUXDCUXD?"), "id": value if key == "id" else None,
            "external_id": value if key == "external_id" else f"e{n}",
            "name": rng.choice(["", " ", f"n{n}", f"n{n}", f"n{n}", f"n{n}"]), "amount": rng.choice([None, str(n), "bad"]),
        })
    stored = [(r["id"], "T", r["external_id"], r["name"], r["amount"], OLD, OLD) for r in table]
    stored += [("other", "S", "k0", "other tenant", 7.0, OLD, OLD), ("free", "T", None, "no key", 8.0, OLD, OLD)]
    target = spark.createDataFrame(stored, THING_SCHEMA)
    columns = ["row", "_action", "external_id", "name", "amount"] + (["id"] if key == "id" else [])
    schema = ", ".join(f"{c} {'long' if c == 'row' else 'string'}" for c in columns)
    rows = spark.createDataFrame([tuple(c[k] for k in columns) for c in changes], schema).repartition(3)

    merged = M.merge(target, rows, thing(overlay), AS_OF, tenant="T", match_key=key, hot_rows=hot_rows)
    want_outcomes, want_rows = sequential(table, changes, key, overlay)
    assert {r.row: r.outcome for r in merged.outcomes.collect()} == want_outcomes
    got = merged.table.collect()
    assert sorted((r.external_id or "", r.name, r.amount or 0) for r in got if r.client_id == "T" and r.id != "free") == sorted(
        (r["external_id"] or "", r["name"], r["amount"] or 0) for r in want_rows
    )
    assert sorted((r.name, r.amount) for r in got if r.id in ("other", "free")) == [("no key", 8.0), ("other tenant", 7.0)]
    assert len({r.id for r in got}) == len(got)
    for r in got:
        if r.created_at == AS_OF:
            assert len(r.id) == 36 and r.updated_at == AS_OF


@pytest.mark.parametrize("hot_rows, overlay", [(1_000_000, "keep"), (20, "replace")])
def test_merge_by_id_never_gives_two_rows_one_external_id(spark, hot_rows, overlay):
    rng = random.Random(hot_rows)
    names = [f"e{i}" for i in range(12)]
    table = [{"id": f"i{k}", "external_id": names[k] if k < 8 else None, "name": f"old {k}", "amount": 1.0} for k in range(10)]
    changes = []
    for n in range(1, 201):
        taken = names[0] if rng.random() < 0.33 else rng.choice([*names, None, ""])  # one value is claimed by a third of all rows
        who = "i0" if rng.random() < 0.3 else rng.choice([f"i{k}" for k in range(14)])
        changes.append({"row": n, "_action": rng.choice("CUUXD"), "id": who, "external_id": taken, "name": rng.choice(["", f"n{n}", f"n{n}"]),
                        "amount": rng.choice([None, str(n), "bad"])})
    stored = [(r["id"], "T", r["external_id"], r["name"], r["amount"], OLD, OLD) for r in table]
    stored += [("i5", "S", "e11", "other tenant", 7.0, OLD, OLD)]
    target = spark.createDataFrame(stored, THING_SCHEMA)
    columns = ["row", "_action", "id", "external_id", "name", "amount"]
    rows = spark.createDataFrame([tuple(c[k] for k in columns) for c in changes], "row long, _action string, id string, external_id string, name string, amount string")
    merged = M.merge(target, rows.repartition(3), thing(overlay), AS_OF, tenant="T", match_key="id", hot_rows=hot_rows, hold=keep)
    want_outcomes, want_rows = sequential(table, changes, "id", overlay)
    outcomes = merged.outcomes.collect()
    assert {r.row: r.outcome for r in outcomes} == want_outcomes
    assert any(r.field == "external_id" and r.message.startswith("Record with external_id='e") for r in outcomes)
    got = [r for r in merged.table.collect() if r.client_id == "T"]
    assert sorted((r.external_id or "", r.name, r.amount or 0) for r in got) == sorted((r["external_id"] or "", r["name"], r["amount"] or 0) for r in want_rows)
    held = [r.external_id for r in got if r.external_id]
    assert len(held) == len(set(held))


def test_claims_that_depend_on_refused_claims(spark):
    # 1 is refused (b holds y), so a keeps x, so 2 is refused, so c keeps z, so 3 is refused; 4 takes what 5 could not
    rows = [(0, "a", "x", False), (0, "b", "y", False), (0, "c", "z", False), (0, "d", "y", False), (1, "a", "y", True), (2, "c", "x", True),
            (3, "e", "z", True), (4, "b", None, False), (5, "e", "y", True), (6, "d", None, False), (7, "e", "y", True), (8, "f", "y", True), (9, "e", "y", True)]
    events = spark.createDataFrame(rows, "at long, who string, value string, claims boolean")
    assert sorted(r["at"] for r in refused_claims(events, 2).collect()) == [1, 2, 3, 5, 8]
    assert refused_claims(events.where("at = 0")).count() == 0 and refused_claims(events.limit(0)).count() == 0


def test_unreadable_values_fail_their_row(spark):
    rows = numbered(spark, ["external_id", "name", "is_supplier"], [("a", "A", "yes"), ("b", "B", "perhaps"), ("c", "C", None)])
    merged = M.merge(empty(spark, VENDOR), rows, VENDOR, AS_OF, tenant="T")
    assert {r.row: (r.outcome, r.field) for r in merged.outcomes.collect()} == {1: ("created", None), 2: ("failed", "is_supplier"), 3: ("created", None)}


def test_hot_keys_are_cut_by_rank_not_by_distance(spark):
    rng = random.Random(8)
    at = [*range(1, 1001), 10**12]  # one row far away
    rows = [("hot", r, rng.choice([True, False, None]), False) for r in at] + [("warm", 2 * r, True, False) for r in range(600)]
    signals = spark.createDataFrame(rows, "__key string, __row long, __signal boolean, __base boolean").repartition(3)
    chunks = numbering.in_chunks(signals, "__key", "__row", 100)
    scanned = numbering.last_before(chunks, "__key", "__row", "__signal", "__exists").collect()
    sizes = Counter((r["__key"], r["__chunk"]) for r in chunks.collect())
    assert max(sizes.values()) == 100 and len(sizes) == 11 + 6
    before, now, total, sums = {}, {}, Counter(), {}
    for key, row, signal, _ in sorted(rows, key=lambda r: r[:2]):
        before[key, row], sums[key, row] = now.get(key), total[key]
        now[key] = now.get(key) if signal is None else signal
        total[key] += row % 5
    added = numbering.sum_before(chunks.selectExpr("*", "__row % 5 AS v"), "__key", "__row", "v", "s").collect()
    assert {(r["__key"], r["__row"]): r.s for r in added} == sums
    assert {(r["__key"], r["__row"]): r["__exists"] for r in scanned} == before


def empty(spark, entity):
    columns = ["id string", "client_id string"]
    columns += [f"{m.name} {m.stored_type.simpleString()}" for m in entity.merge_columns]
    columns += [f"{fk.column} string" for fk in entity.foreign_keys] + ["created_at timestamp_ntz", "updated_at timestamp_ntz"]
    return spark.createDataFrame([], ", ".join(columns))


def numbered(spark, columns, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], "row long, " + ", ".join(f"`{c}` string" for c in columns))


def counts(merged):
    row = M.outcome_counts(merged.outcomes).head()
    return [row.imported_count, row.updated_count, row.deleted_count, row.skipped_count, row.failed_count]


def test_vendor_scenario(spark):
    """Ten creates; the same as upserts; the same as creates; then two C, two U, three X (two new), one D."""
    columns = ["external_id", "name", "email", "status"]
    ten = numbered(spark, columns, [(f"V{i}", f"Vendor {i}", f"v{i}@x.test", "ACTIVE") for i in range(10)])
    created = M.merge(empty(spark, VENDOR), ten, VENDOR, AS_OF, "T")
    assert counts(created) == [10, 0, 0, 0, 0]
    table = spark.createDataFrame(created.table.collect(), created.table.schema)
    first = table.filter("external_id = 'V0'").head()
    assert (first.email_address, first.currency, first.is_supplier, first.is_customer, first.phone) == ("v0@x.test", "USD", True, False, None)
    assert counts(M.merge(table, ten, VENDOR, AS_OF, "T", "upsert")) == [0, 10, 0, 0, 0]
    again = M.merge(table, ten, VENDOR, AS_OF, "T")
    assert counts(again) == [0, 0, 0, 0, 10]
    assert again.outcomes.head().message.startswith("Record with external_id='V")
    mixed = numbered(spark, ["_action", *columns], [
        ("C", "N1", "New 1", "n1@x.test", "ACTIVE"), ("C", "N2", "New 2", None, "ACTIVE"),
        ("U", "V1", "Vendor one", "one@x.test", "ACTIVE"), ("U", "V2", "Vendor two", None, None),
        ("X", "U1", "Up 1", None, "ACTIVE"), ("X", "U2", "Up 2", None, "ACTIVE"), ("X", "V3", "Vendor three", None, "ACTIVE"),
        ("D", "V8", None, None, None),
    ])
    final = M.merge(table, mixed, VENDOR, AS_OF, "T")
    assert counts(final) == [4, 3, 1, 0, 0]
    rows = {r.external_id: r for r in final.table.collect()}
    assert len(rows) == 13 and "V8" not in rows
    assert (rows["V1"].name, rows["V1"].email_address) == ("Vendor one", "one@x.test")
    assert (rows["V2"].email_address, rows["V2"].status) == (None, None)  # vendors take nulls over


def test_invoice_and_bill_columns(spark):
    registry = standard_registry()
    invoices = numbered(spark, ["external_id", "amount", "date", "description"], [("I1", "12.5", "2025-01-01", "first"), ("I2", "x", "2025-01-01", None)])
    merged = M.merge(empty(spark, INVOICE), invoices, INVOICE, AS_OF, "T")
    assert counts(merged) == [1, 0, 0, 0, 1]
    row = merged.table.head()
    assert (float(row.total_amount), row.issue_date, row.memo, row.status, row.sub_total) == (12.5, datetime(2025, 1, 1), "first", "DRAFT", None)
    vendors = spark.createDataFrame([("v-1", "T", "EXT"), ("v-2", "S", "EXT2")], "id string, client_id string, external_id string")
    bills = numbered(spark, ["external_id", "amount", "date", "vendor_external_id"], [
        ("B1", "1", "2025-01-01T00:00:00+02:00", "EXT"), ("B2", "2", "someday", "EXT2"), ("B1", "3", "", "none")])
    merged = M.merge(empty(spark, BILL), bills, BILL, AS_OF, "T", "upsert", tables={"vendor": vendors}, registry=registry)
    rows = {r.external_id: r for r in merged.table.collect()}
    assert {r.row: r.outcome for r in merged.outcomes.collect()} == {1: "created", 2: "created", 3: "failed"}
    assert (rows["B1"].vendor_id, rows["B1"].date) == ("v-1", datetime(2024, 12, 31, 22))
    assert (rows["B2"].vendor_id, rows["B2"].date) == (None, AS_OF)  # other tenant's vendor; unreadable date


def test_direct_ids_and_repeated_lookups(spark):
    vendors = spark.createDataFrame([("v-1", "T", "EXT"), ("v-2", "T", "EXT")], "id string, client_id string, external_id string")
    good = "0f8fad5b-d9cb-469f-a165-70867728950e"
    bills = numbered(spark, ["external_id", "amount", "date", "vendor_id", "vendor_external_id"], [
        ("B1", "1", "2025-01-01", "not-a-uuid", None), ("B2", "2", "2025-01-01", good, "EXT"), ("B3", "3", "2025-01-01", None, "EXT")])
    merged = M.merge(empty(spark, BILL), bills, BILL, AS_OF, "T", "upsert", tables={"vendor": vendors}, registry=standard_registry())
    lines = [(r.row, r.outcome, r.field) for r in merged.outcomes.orderBy("row").collect()]
    assert lines == [(1, "failed", "vendor_id"), (2, "created", None), (3, "created", None)]
    assert {r.external_id: r.vendor_id for r in merged.table.collect()} == {"B2": good, "B3": "v-1"}


def test_config_checks(spark):
    rows = numbered(spark, ["external_id", "name"], [("a", "b")])
    with pytest.raises(ValueError, match="not a match key"):
        M.merge(empty(spark, VENDOR), rows, VENDOR, AS_OF, "T", match_key="colour")
    with pytest.raises(ValueError, match="import mode"):
        M.merge(empty(spark, VENDOR), rows, VENDOR, AS_OF, "T", mode="drop")


def test_whole_import(spark, tmp_path):
    registry = standard_registry()
    rows = numbered(spark, ["external_id", "Project Code", "name"], [("P1", "A", "Alpha"), ("P2", "B", " "), ("P1", "C", "Gamma")])
    kw = dict(registry=registry, target=empty(spark, PROJECT), as_of=AS_OF, root=str(tmp_path), tenant="T")
    spec = ImportSpec.parse({"entity": "project", "fields": [{"source": "Project Code", "target": "code"}]})
    refused = run_import(rows, spec, **kw)
    assert (refused.status, refused.error_message, refused.table) == ("failed", "Validation failed: 1 invalid rows out of 3", None)
    assert refused.error_file.endswith("imports/T/job/run/validation_errors.jsonl")
    assert [(r.row, r.field) for r in spark.read.json(refused.error_file).collect()] == [(2, "name")]
    skip = ImportSpec("project", mappings=spec.mappings, on_invalid="skip")
    done = run_import(rows, skip, version=1, run="r2", **kw)
    record = done.record(rows).head()
    assert (record.total_rows, record.invalid_count, record.imported_count, record.failed_count, record.status) == (3, 1, 1, 1, "failed")
    assert done.error_message == "1 records failed to import"
    assert [(r.code, r.name, r.currency) for r in done.table.collect()] == [("A", "Alpha", "USD")]
    assert spark.read.json(done.error_file).head().row == 3
    no_code = run_import(rows.drop("Project Code"), skip, **kw)
    assert no_code.table is None and no_code.counts["invalid_count"] == 2
    nothing = run_import(rows.limit(0), skip, run="r3", **kw)
    assert (nothing.status, nothing.table) == ("failed", None)
    assert [(r.row, r.message) for r in spark.read.json(nothing.error_file).collect()] == [(1, "CSV file has no data rows")]


def test_nothing_is_random(spark):
    rows = numbered(spark, ["external_id", "name"], [("a", "b"), (None, "c")])
    one = M.merge(empty(spark, VENDOR), rows, VENDOR, AS_OF, "T").table.collect()
    two = M.merge(empty(spark, VENDOR), rows.repartition(2), VENDOR, AS_OF, "T").table.collect()
    assert sorted(r.id for r in one) == sorted(r.id for r in two)
