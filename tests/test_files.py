from __future__ import annotations

import json
import random
from collections import defaultdict
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyferry.functions import dates, ids, numbers
from tallyferry.operators import numbering, rates
from tallyferry.plans.catalog import PROJECT, standard_registry
from tallyferry.plans.imports import import_folder
from tallyferry.plans.specs import ImportSpec
from tallyferry.sources import files, inbox, sinks
from tallyferry.sources.snapshots import PartitionedTable
from tallyferry.sources.tables import serialise
from test_merge import empty


def test_csv_cells(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('x,y,_action\n1,2,C\n\n,,\n"a\nb","q""z",\n3\n4,5,U,6\n, 7 ,""\n')
    df = files.scan_csv(spark, str(path))
    assert files.discover_columns(df) == (["x", "y"], True)
    got = [tuple(r) for r in files.number_rows(df, per_file=False).orderBy("row").collect()]
    assert got == [
        (1, "1", "2", "C"), (2, None, None, None), (3, "a\nb", 'q"z', None), (4, "3", None, None), (5, "4", "5", "U"), (6, None, " 7 ", None),
    ]
    with pytest.raises(ValueError, match="Unsupported file format: .txt"):
        files.scan_file(spark, "x.txt")


def test_row_numbers_of_split_files(spark, tmp_path):
    for name, n in (("a", 5000), ("b", 3000)):
        (tmp_path / f"{name}.csv").write_text("id\n" + "".join(f"{name}{i:05d}\n" for i in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = files.scan_csv(spark, str(tmp_path), quoted_newlines=False)
        numbered = files.number_rows(df)
        assert df.rdd.getNumPartitions() > 5
        assert numbered.filter(F.col("row") != F.substring("id", 2, 5).cast("long")).count() == 0
        assert numbered.groupBy("file").agg(F.max("row").alias("n")).agg(F.sum("n")).head()[0] == 8000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_json_shapes(spark, tmp_path):
    cases = {"a": '[{"n": 1, "t": "x"}, {"n": 2}]', "b": '{"n": 3}', "c": '[{"n": 1}, 5, "s", {"n": 2}]', "d": "[1,", "e": "7", "f": '{"n":\n 4}\n', "g": '{"n": 1}\n{"n": 2}\n'}
    for name, body in cases.items():
        (tmp_path / f"{name}.json").write_text(body)
    assert [(r.n, r.t) for r in files.scan_file(spark, str(tmp_path / "a.json")).collect()] == [(1, "x"), (2, None)]
    assert [r.n for r in files.scan_file(spark, str(tmp_path / "b.json")).collect()] == [3]
    found = files.json_problems(spark, str(tmp_path)).collect()
    assert sorted((r.file[-6], r.row, r.message) for r in found) == [
        ("c", 2, "Record must be an object"), ("c", 3, "Record must be an object"), ("d", 0, "Invalid JSON"), ("e", 0, "JSON must be an array or object"),
        ("g", 0, "Invalid JSON"),
    ]


def test_gate(spark, tmp_path):
    (tmp_path / "ok.CSV").write_text("a\n1\n")
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "x.pdf").write_text("x")
    (tmp_path / "big.csv").write_text("a\n" * 100)
    paths = [f"{tmp_path}/{n}" for n in ("ok.CSV", "empty.json", "x.pdf", "big.csv", "gone.csv")]
    expected = spark.createDataFrame([(p,) for p in paths], "path string")
    gated = files.gate_files(files.list_files(spark, str(tmp_path)), expected, max_bytes=150)
    found = {r.path.rsplit("/", 1)[1]: r.message for r in gated.collect()}
    assert found.pop("big.csv").startswith("File too large. Maximum size: 0.0001")
    assert found == {
        "ok.CSV": None, "empty.json": "File is empty", "x.pdf": "Invalid file format. Allowed: .csv, .json",
        "gone.csv": f"File not found: {tmp_path}/gone.csv",
    }


def test_export_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", None), (2, 'a,"b"', "x")], "`Bill ID` int, name string, note string")
    assert sinks.write_export(df, f"{tmp_path}/csv") == 2
    back = files.scan_csv(spark, f"{tmp_path}/csv")
    assert back.columns == ["Bill ID", "name", "note"] and sorted(r.name for r in back.collect()) == ['a,"b"', "é"]
    assert sinks.write_export(df.filter("false"), f"{tmp_path}/none") == 0
    assert spark.read.text(f"{tmp_path}/none").head()[0] == "Bill ID,name,note"
    assert sinks.write_export(df, f"{tmp_path}/json", "json") == 2
    lines = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/json").collect()]
    assert {"Bill ID": 1, "name": "é", "note": None} in lines
    typed = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-15 10:00:00' AS at, CAST(500 AS DECIMAL(15,2)) AS amount")
    sinks.write_export(typed, f"{tmp_path}/typed")
    assert tuple(files.scan_csv(spark, f"{tmp_path}/typed").head()) == ("2024-01-15T10:00:00Z", "500.0")
    with pytest.raises(ValueError):
        sinks.write_export(df, "x", "pdf")
    assert sinks.export_path("r", "t", "j", "u", "json") == "r/exports/t/j/u.json"


def test_rename_keeps_the_later_of_two(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert files.rename(df, {"a": "z", "c": "z"}).head().asDict() == {"z": 3, "b": 2}


def test_partitions_are_replaced_once(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), f"k{i}" if i % 5 else None) for i in range(50)], "id string, external_id string")
    table = PartitionedTable(spark, str(tmp_path), rows.schema, buckets=8)
    table.create(rows)
    assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, rows.collect()))
    touched = table.touched(spark.createDataFrame([("k1",), (None,)], "external_id string"))
    assert len(touched) == 1
    calls = []

    def made(part):
        calls.append(1)
        gone = part.filter("external_id <> 'k1'")
        return gone.unionByName(spark.createDataFrame([(f"n{i}", None) for i in range(9)], rows.schema))

    for _ in range(3):  # a batch that runs again is not applied again
        table.change(1, touched, made)
    assert len(calls) == 1
    left = sorted([str(i) for i in range(50) if i != 1] + [f"n{i}" for i in range(9)])
    assert sorted(r.id for r in table.read().collect()) == left
    plan = table.read(touched)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan


def test_a_bucket_that_lost_its_rows(spark, tmp_path):
    rows = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", None)], "id string, external_id string")
    table = PartitionedTable(spark, str(tmp_path), rows.schema, buckets=64)
    table.create(rows)
    table.change(1, table.touched(rows.limit(1)), lambda part: part.limit(0))
    assert sorted(r.id for r in table.read().collect()) == ["2", "3"]
    table.change(2, [], lambda part: part.unionByName(spark.createDataFrame([("4", None)], rows.schema)))
    assert sorted(r.id for r in table.read().collect()) == ["2", "3", "4"]


def test_numbers_and_dates(spark):
    cases = ["12", " 1.5 ", "1_000", "12.5d", "1e3", "inf", "-NaN", "", "abc", ".5", "5.", "1__0", "0x1A"]
    rows = spark.createDataFrame([(c,) for c in cases], "t string")
    got = {r.t: r.n for r in rows.select("t", numbers.parse_number(F.col("t")).alias("n")).collect()}
    assert [got[c] for c in ("12", " 1.5 ", "1_000", "1e3", "inf", ".5", "5.")] == [12, 1.5, 1000, 1000, float("inf"), 0.5, 5]
    assert [got[c] for c in ("12.5d", "", "abc", "1__0", "0x1A")] == [None] * 5 and got["-NaN"] != got["-NaN"]
    stamps = {
        "2024-01-15T10:30:00Z": datetime(2024, 1, 15, 10, 30), "2024-01-15T10:30:00+05:30": datetime(2024, 1, 15, 5),
        "2024-01-15 10:30:00.25": datetime(2024, 1, 15, 10, 30, 0, 250000), "2024-01-15": datetime(2024, 1, 15),
        "2024-1-5": datetime(2024, 1, 5), "2024-13-45": None, "15/01/2024": None, "": None, "10:30": None,
    }
    rows = spark.createDataFrame([(c,) for c in stamps], "t string")
    assert {r.t: r.s for r in rows.select("t", dates.parse_timestamp(F.col("t")).alias("s")).collect()} == stamps
    uuids = {"{6BA7B810-9DAD-11D1-80B4-00C04FD430C8}": "6ba7b810-9dad-11d1-80b4-00c04fd430c8", "nope": None}
    rows = spark.createDataFrame([(c,) for c in uuids], "t string")
    assert {r.t: r.u for r in rows.select("t", ids.parse_uuid(F.col("t")).alias("u")).collect()} == uuids
    edge = spark.sql("SELECT CAST(1.50 AS DECIMAL(15,2)) AS d, TIMESTAMP_NTZ '2024-01-01 00:00:00.5' AS t")
    assert tuple(serialise(edge).head()) == (1.5, "2024-01-01T00:00:00.500000Z")


def test_running_totals_and_row_numbers(spark):
    rng = random.Random(7)
    keys = sorted(rng.sample(range(10**15), 500))
    df = spark.createDataFrame([(k, k % 7, Decimal(k % 9)) for k in keys], "k long, v long, d decimal(9,2)").repartition(4)
    totals = numbering.running_totals(df, "k", ["v", "d"])
    assert "SinglePartition" not in totals._jdf.queryExecution().toString()
    got = {r.k: (r.running_v, r.running_d) for r in totals.collect()}
    assert got == {k: (sum(x % 7 for x in keys[: i + 1]), sum(x % 9 for x in keys[: i + 1])) for i, k in enumerate(keys)}
    numbered = numbering.number_by_key(df, "k")
    assert "SinglePartition" not in numbered._jdf.queryExecution().toString()
    assert {r.k: r.row for r in numbered.collect()} == {k: i for i, k in enumerate(keys, 1)}
    assert numbering.number_by_key(df.limit(0), "k").count() == numbering.running_totals(df.limit(0), "k", ["v"]).count() == 0


def test_row_numbers_by_text_and_by_two_keys(spark):
    rows = [(None, 2), ("b", 1), ("ab", 9), (None, 1), ("b", 0), ("", 5)]
    df = spark.createDataFrame(rows, "a string, b long")
    got = {(r.a, r.b): r.row for r in numbering.number_by_key(df, ["a", "b"]).collect()}
    assert got == {(None, 1): 1, (None, 2): 2, ("", 5): 3, ("ab", 9): 4, ("b", 0): 5, ("b", 1): 6}


@pytest.mark.parametrize("hot_rows", [1_000_000, 200, 1])
def test_trailing_counts_with_a_hot_key_and_ties(spark, hot_rows):
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    events = []
    for i in range(900):
        key = "hot" if i % 3 == 0 else f"k{i % 5}"
        events.append((i, key, start + timedelta(microseconds=rng.choice([0, 1, 500_000]) + 1_000_000 * rng.randrange(0, 900))))
    events += [(1000 + i, "hot", start + timedelta(seconds=60 * i)) for i in range(5)]
    df = spark.createDataFrame(events, "id int, k string, ts timestamp_ntz").repartition(4)
    found = rates.trailing_counts(df, "k", "ts", [60, 200], hot_rows=hot_rows)
    got = {r.id: (r.last_60s, r.last_200s) for r in found.collect()}
    assert found.columns == [*df.columns, "last_60s", "last_200s"]
    by_key = defaultdict(list)
    for i, k, t in events:
        by_key[k].append(t)

    def brute(k, t, s):
        return sum(1 for other in by_key[k] if t - timedelta(seconds=s) < other <= t) - 1

    assert got == {i: (brute(k, t, 60), brute(k, t, 200)) for i, k, t in events}


def test_json_after_the_first_value(spark, tmp_path):
    cases = {'{"n": 1}\n{"n": 2}': False, "[1] x": False, "1, 2": False, "5] , [6": False, '5}, {"d": 6': False, "": False, "null": True, ' {"n": [1, "]}"]} \n': True, "[]": True}
    df = spark.createDataFrame([(c,) for c in cases], "value string")
    got = {r.value: r.ok for r in df.select("value", files.parsed_json(F.col("value")).isNotNull().alias("ok")).collect()}
    assert got == cases


def put(folder, **named):
    folder.mkdir(exist_ok=True)
    for name, body in named.items():
        path = folder / name.replace("__", ".").replace("_0_", " ").replace("_p_", "+%[")
        path.write_bytes(body if isinstance(body, bytes) else body.encode())


def test_names_with_blanks_and_signs(spark, tmp_path):
    put(tmp_path / "in", a_0_b__csv="x\n1\n", c_p_d__csv="x\n2\n")
    listed = {r.path.rsplit("/", 1)[1]: (r.length, r.message) for r in files.gate_files(files.list_files(spark, str(tmp_path / "in"))).collect()}
    assert listed == {"a b.csv": (4, None), "c+%[d.csv": (4, None)}
    found = inbox.inspect(spark, str(tmp_path / "in"))
    assert found.problems.count() == 0 and len(found.groups) == 1
    assert sorted((r.file.rsplit("/", 1)[1], r.row, r.x) for r in found.groups[0].rows.collect()) == [("a b.csv", 1, "1"), ("c+%[d.csv", 1, "2")]


def test_columns_per_file(spark, tmp_path):
    put(
        tmp_path, a__csv='_action,"full, name","say ""hi"""\nC,x,y\n', b__csv="\n\nonly\n", c__json='[{"b": 1, "_action": "C"}, {"a": {"z": 1}, "b": null}, 7]',
        d__json='{"k": 1}', e__json="[]", f__txt="x", g__csv=b"caf\xe9,y\n",
    )
    got = {r.file.rsplit("/", 1)[1]: (r.columns, r.has_action) for r in inbox.discovered(spark, str(tmp_path)).collect()}
    assert got.pop("g.csv")[0][1] == "y"
    assert got == {
        "a.csv": (["full, name", 'say "hi"'], True), "b.csv": (["only"], False), "c.json": (["a", "b"], True), "d.json": (["k"], False),
    }


def test_a_folder_of_plain_and_quoted_files(spark, tmp_path):
    plain = "id,t\n" + "".join(f"{i},x{i}\n" for i in range(20_000))
    put(tmp_path, a__csv=plain, b__csv='t,id\n"two\nlines",1\n"a ""q"" b",2\n', c__csv='id,t\n1,"one, line"\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        shapes = {r.file.rsplit("/", 1)[1]: (r.header, r.multiline) for r in inbox.csv_profiles(spark, [str(tmp_path / f"{n}.csv") for n in "abc"]).collect()}
        assert shapes == {"a.csv": (["id", "t"], False), "b.csv": (["t", "id"], True), "c.csv": (["id", "t"], False)}
        rows = inbox.scan_csv_folder(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 5  # the plain file is split
        got = {(r.file[-5], r.row): (r.id, r.t) for r in rows.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = {("a", i + 1): (str(i), f"x{i}") for i in range(20_000)}
    assert got == want | {("b", 1): ("1", "two\nlines"), ("b", 2): ("2", 'a "q" b'), ("c", 1): ("1", "one, line")}


@pytest.mark.parametrize("on_invalid", ["abort", "skip"])
def test_folder_import(spark, tmp_path, on_invalid):
    put(
        tmp_path, a__csv="external_id,code,name\na1,A,Alpha\na2,B,\n", b__csv="name,external_id,code\nBeta,b1,B\nBeta two,b2,C\n",
        c__csv=b"external_id,code,name\nc1,C,caf\xe9\n", d__csv="external_id,code\nd1,D\n", e__csv="external_id,code,name\n", f__csv="\n\n",
        g__json='[{"external_id": "g1", "code": "G", "name": "Gamma"}]', h__json='[{"external_id": "h1", "code": "H", "name": "H"}, 5]', i__json="{", j__json="7",
        k__json="[]", l__txt="x", m__csv="", n__csv="external_id,code,name\nn1,N," + "x" * 140_000 + "\n", o__csv='external_id,code,name\no1,O,"two\nlines"\na1,A,again\n',
    )
    gone = spark.createDataFrame([(f"{tmp_path}/z.csv",)], "path string")
    raw = {"entity": "project", "options": {"on_invalid": on_invalid}}
    done = import_folder(spark, str(tmp_path), ImportSpec.parse(raw), standard_registry(), empty(spark, PROJECT), datetime(2025, 1, 1), "T", expected=gone)
    errors = sorted((r.file.rsplit("/", 1)[1], r.row, r.field, r.message) for r in done.errors.collect())
    assert errors == [
        ("a.csv", 2, "name", "Required field 'name' is missing or empty"), ("c.csv", 0, None, files.BAD_ENCODING),
        ("d.csv", 0, None, "Missing required fields: name"), ("e.csv", 1, None, "CSV file has no data rows"), ("f.csv", 0, None, "CSV file has no header row"),
        ("h.json", 2, None, "Record must be an object"), ("i.json", 0, None, "Invalid JSON"), ("j.json", 0, None, "JSON must be an array or object"),
        ("l.txt", 0, None, files.BAD_SUFFIX), ("m.csv", 0, None, files.EMPTY), ("n.csv", 0, None, inbox.CELL_TOO_LONG), ("z.csv", 0, None, f"File not found: {tmp_path}/z.csv"),
    ]
    keys = {r.external_id: r.name for r in done.table.collect()}
    want = {"b1": "Beta", "b2": "Beta two", "g1": "Gamma", "o1": "two\nlines"}
    assert keys == want | ({"a1": "Alpha"} if on_invalid == "skip" else {"a1": "again"})
    outcomes = {(r.file.rsplit("/", 1)[1], r.row): r.outcome for r in done.outcomes.collect()}
    assert outcomes[("o.csv", 2)] == ("failed" if on_invalid == "skip" else "created") and ("a.csv", 2) not in outcomes
    listed = {r.file.rsplit("/", 1)[1]: (r.rows, r.refused) for r in done.files.collect()}
    assert listed["a.csv"] == (2, on_invalid == "abort") and listed["k.json"] == (0, False) and listed["o.csv"] == (2, False)
    assert {f for f, (_, refused) in listed.items() if refused} == {f for f, *_ in errors} - ({"a.csv"} if on_invalid == "skip" else set())
