from __future__ import annotations

import random
import time
from datetime import datetime

import pytest

from tallyferry.operators import merge as M
from tallyferry.operators.history import fold_status, partial_state
from tallyferry.plans.catalog import PROJECT
from tallyferry.sources.files import scan_csv
from tallyferry.sources.snapshots import PartitionedTable
from tallyferry.streaming import jobs
from tallyferry.streaming.jobs import stream_dedup, stream_import
from tallyferry.streaming.sources import stream_csv, stream_parquet
from test_merge import empty

AS_OF = datetime(2025, 2, 1)


def test_stream_import_equals_batch_and_a_batch_can_run_again(spark, tmp_path):
    columns = ["row", "_action", "external_id", "code", "name"]
    inbox = tmp_path / "in"
    inbox.mkdir()
    waves = [
        "1,C,a,A,Alpha\n2,C,b,B,Beta\n3,U,a,,Alpha two\n",
        "4,U,a,A2,Alpha three\n5,D,b,,\n6,X,c,C,<script>\n7,C,b,B2,Beta again\n",
        "8,D,a,,\n9,X,d,D,Delta\n10,oops,e,E,Eps\n",
    ]
    base = empty(spark, PROJECT)
    table = PartitionedTable(spark, str(tmp_path / "table"), base.schema, buckets=4)
    table.create(base)

    def go():
        arriving = stream_csv(spark, str(inbox), columns, files_per_batch=1)
        stream_import(arriving, PROJECT, table, str(tmp_path / "log"), str(tmp_path / "cp"), AS_OF, "T").awaitTermination()

    for i, body in enumerate(waves):
        (inbox / f"{i}.csv").write_text(",".join(columns) + "\n" + body)
        go()
    outcomes = spark.read.parquet(str(tmp_path / "log" / "outcomes"))
    assert {r.row: r.outcome for r in outcomes.collect()} == {
        1: "created", 2: "created", 4: "updated", 5: "deleted", 7: "created", 8: "deleted", 9: "created",
    }
    errors = spark.read.json(str(tmp_path / "log" / "errors"))
    assert sorted((r.row, r.field) for r in errors.collect()) == [(3, "code"), (6, "name"), (10, "_action")]
    rows = [(r.external_id, r.code, r.name) for r in table.read().collect()]
    assert sorted(rows) == [("b", "B2", "Beta again"), ("d", "D", "Delta")]
    good = scan_csv(spark, str(inbox)).selectExpr("CAST(row AS long) AS row", "* EXCEPT (row)").filter("row NOT IN (3, 6, 10)")
    batch = M.merge(base, good, PROJECT, AS_OF, "T").table
    assert sorted((r.external_id, r.code, r.name) for r in batch.collect()) == sorted(rows)


def test_dedup_and_single_file_streams(spark, tmp_path):
    df = spark.sql("SELECT id, TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, id) AS ts FROM range(20)")
    df.unionByName(df).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = stream_parquet(spark, str(tmp_path / "in"))
    stream_dedup(source, "id", "ts", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(20))


def arrivals(spark, path, seconds):
    """One file per list of seconds after noon; ids count up."""
    n = 0
    for i, part in enumerate(seconds):
        rows = [(n + k, s, "ab"[s % 2]) for k, s in enumerate(part)]
        n += len(rows)
        df = spark.createDataFrame(rows, "id long, s long, who string").selectExpr(
            "id", "who", "TIMESTAMP_NTZ '2024-01-01 12:00:00' + make_dt_interval(0, 0, 0, s) AS ts", "s % 3 = 0 AS bad"
        )
        df.coalesce(1).write.mode("append").parquet(str(path))
        time.sleep(1.1)  # files are taken in the order of their times, which are in whole seconds
    return stream_parquet(spark, str(path), files_per_batch=1)


def test_windows_still_open_are_reported_once_and_late_rows_counted(spark, tmp_path):
    parts = [[0, 3, 61, 62], [4000, 4001], [5, 3990, 4002], [4003]]  # 5 is too late, 3990 is not
    source = arrivals(spark, tmp_path / "in", parts)
    sink, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    jobs.stream_progress(source, "ts", "bad", sink, checkpoint, delay="30 seconds").awaitTermination()
    lines = jobs.windows_so_far(spark, sink, checkpoint, ["rows", "flagged"])
    got = {(r.end - datetime(2024, 1, 1, 12)).total_seconds(): (r.rows, r.flagged) for r in lines.collect()}
    assert got == {5: (2, 2), 65: (2, 0), 3995: (1, 1), 4005: (4, 1)} and lines.count() == 4
    assert jobs.late(spark.read.parquet(str(tmp_path / "in")), lines, "rows") == 1
    closed = spark.read.parquet(sink)
    assert closed.count() < lines.count()
    # Looking at open windows does not close them: the stream goes on and counts into them.
    more = arrivals(spark, tmp_path / "in", [[4004]])
    jobs.stream_progress(more, "ts", "bad", sink, checkpoint, delay="30 seconds").awaitTermination()
    again = {r.end: r.rows for r in jobs.windows_so_far(spark, sink, checkpoint, ["rows", "flagged"]).collect()}
    assert again[datetime(2024, 1, 1, 13, 6, 45)] == 5 and len(again) == 4


def test_rate_windows_of_a_minute_and_an_hour_with_limits(spark, tmp_path):
    seconds = [[s for s in range(0, 120, 2)] + [1, 3, 5]]
    source = arrivals(spark, tmp_path / "in", seconds)
    sink, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    jobs.stream_rates(source, ["who"], "ts", sink, checkpoint, (jobs.MINUTE, jobs.HOUR)).awaitTermination()
    windows = jobs.windows_so_far(spark, sink, checkpoint, ["requests"], 2)
    over = jobs.beyond_limits(windows, "who", {"a": (20, 50), "default": (2, 2)})
    got = {(r.who, (r.start - datetime(2024, 1, 1, 12)).total_seconds(), (r.end - r.start).total_seconds()): (r.requests, r.over) for r in over.collect()}
    want = {}
    for span, slide, a, d in ((60, 10, 20, 2), (3600, 600, 50, 2)):
        for start in range(-span + slide, 120, slide):
            for who in "ab":
                if n := sum(start <= s < start + span and "ab"[s % 2] == who for s in seconds[0]):
                    want[who, start, span] = (n, max(n - (a if who == "a" else d), 0))
    assert got == want
    source_rows = spark.read.parquet(str(tmp_path / "in"))
    assert jobs.late(source_rows, windows.where("end - start = INTERVAL '60' SECOND"), "requests", 6) == 0


def test_windows_of_a_stream_without_rows(spark, tmp_path):
    spark.createDataFrame([], "ts timestamp_ntz, bad boolean").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("ts timestamp_ntz, bad boolean").parquet(str(tmp_path / "in"))
    jobs.stream_progress(source, "ts", "bad", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert jobs.windows_so_far(spark, str(tmp_path / "out"), str(tmp_path / "cp"), ["rows", "flagged"]).count() == 0


def test_dedup_counts_late_rows(spark, tmp_path):
    source = arrivals(spark, tmp_path / "in", [[0, 1], [4000], [4001], [2, 3], [4002]])  # lateness lags one batch behind
    query = jobs.stream_dedup(source, "id", "ts", str(tmp_path / "out"), str(tmp_path / "cp"), delay="30 seconds")
    query.awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2, 3, 6]
    assert jobs.late_rows(query) == 2


def status_lines(rng, n):
    words = ["queued", "running", "done", "failed"]
    return [
        (rng.randrange(12), i, rng.choice(words), rng.choice([None, i]), rng.choice([None, i]), rng.choice([None, f"e{i}"]), rng.choice([None, f"m{i}"]))
        for i in range(n)
    ]


LOG = "run_id long, at long, status string, started_at long, completed_at long, error_message string, result_metadata string"


@pytest.mark.parametrize("epoch", [1, 3, 100])
def test_run_state_is_compacted_and_keeps_no_streaming_state(spark, tmp_path, epoch):
    rng = random.Random(epoch)
    lines = status_lines(rng, 280)
    rng.shuffle(lines)  # events of a run arrive in any order, over several batches
    for i in range(7):
        spark.createDataFrame(lines[i * 40 : (i + 1) * 40], LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = stream_parquet(spark, str(tmp_path / "in"), files_per_batch=1)
    sink, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    query = jobs.stream_latest_state(source, ["at"], sink, checkpoint, epoch=epoch)
    query.awaitTermination()
    assert all(p["stateOperators"] == [] for p in query.recentProgress)  # memory holds one batch, never all runs
    got = jobs.read_latest_state(spark, sink, source, ["at"], 6 // epoch)
    want = sorted(map(tuple, fold_status(spark.createDataFrame(lines, LOG), ["at"]).select(got.columns).collect()))
    assert sorted(map(tuple, got.collect())) == want
    if epoch == 1:
        assert len(got.inputFiles()) and all("/whole/epoch=6/" in f for f in got.inputFiles())
        left = spark.read.parquet(f"{sink}/whole").groupBy("epoch").count().collect()
        assert sorted(r.epoch for r in left) == [5, 6]  # older ones were emptied
        schema = partial_state(spark.createDataFrame([], LOG), ["at"]).schema
        jobs.compact_state(spark, sink, schema, 6)  # a batch that runs again
        again = jobs.read_latest_state(spark, sink, source, ["at"], 6)
        assert sorted(map(tuple, again.collect())) == want
