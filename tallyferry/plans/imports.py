"""A whole import: number, rename, validate, gate, merge, write (2.K, 2.L, B4-B9, K18, K19)."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyferry.functions.rules import NO_ROWS
from tallyferry.operators import merge as merging, numbering, validation
from tallyferry.plans.registry import Registry
from tallyferry.plans.specs import ImportSpec
from tallyferry.session import keep
from tallyferry.sources import inbox
from tallyferry.sources.files import MAX_FILE_BYTES, ROW, rename
from tallyferry.sources.inbox import FILE
from tallyferry.sources.sinks import import_error_path, write_errors, write_snapshot

# Phases of error files and the message of a refused import.
REFUSED = "Validation failed: {invalid} invalid rows out of {total}"


@dataclass(frozen=True)
class ImportResult:
    """What a run reports. `table` is the new table, or None when nothing was imported."""

    status: str
    error_message: str | None
    counts: dict[str, Any]
    error_file: str | None
    table: DataFrame | None

    def record(self, like: DataFrame) -> DataFrame:
        """The result as one row."""
        names = ["total_rows", "valid_count", "invalid_count", *(f"{w}_count" for w in ("imported", "updated", "deleted", "skipped", "failed"))]
        values = [self.counts.get(n) for n in names]
        schema = "status string, error_message string, error_file string, " + ", ".join(f"{n} long" for n in names)
        return like.sparkSession.createDataFrame([(self.status, self.error_message, self.error_file, *values)], schema)


def run_import(
    rows: DataFrame,
    spec: ImportSpec,
    registry: Registry,
    target: DataFrame,
    as_of: datetime,
    root: str,
    tenant: object = None,
    job: str = "job",
    run: str = "run",
    tables: Mapping[str, DataFrame] | None = None,
    row: str = ROW,
    version: int | None = None,
) -> ImportResult:
    """Run one import over numbered rows (see `sources.files.number_rows`).

    The validated rows are written once to the scratch folder, since counts, error lines and merge all
    read them. Only one-row summaries come back to the driver.
    """
    entity = registry.get(spec.entity)
    data = rename(rows, spec.mappings)
    header = validation.header_errors([c for c in data.columns if c != row], entity)
    checked = keep(validation.validate(data, entity, row), "validated")
    found = validation.summary(checked, len(header)).head()
    counts: dict[str, Any] = {"total_rows": found.total, "valid_count": found.valid, "invalid_count": found.invalid}

    error_file = None
    if found.total == 0:
        header = [*header, {"row": 1, "field": None, "message": NO_ROWS}]
    if found.invalid or header:
        error_file = import_error_path(root, tenant, job, run, "validation")
        lines = validation.error_rows(checked)
        if header:
            lines = lines.unionByName(_file_lines(rows, header))
        write_errors(lines, error_file)
    if found.invalid and (spec.on_invalid == "abort" or header):
        message = REFUSED.format(invalid=found.invalid, total=found.total)
        return ImportResult("failed", message, counts, error_file, None)

    good = checked.filter("is_valid").drop(validation.ERRORS, validation.VALID)
    merged = merging.merge(
        target, good, entity, as_of, tenant, spec.mode, spec.match_key, tables, registry, run, row, hold=keep
    )
    summary = merging.run_status(merging.outcome_counts(merged.outcomes)).head().asDict()
    counts.update({k: v for k, v in summary.items() if k.endswith("_count")})
    if summary["failed_count"]:
        error_file = import_error_path(root, tenant, job, run, "import")
        write_errors(merged.outcomes.filter(f"outcome = '{merging.FAILED}'"), error_file)
    table = merged.table
    if version is not None:
        path = write_snapshot(table, f"{root}/{spec.entity}", version)
        table = rows.sparkSession.read.schema(table.schema).parquet(path)
    return ImportResult(summary["status"], summary["error_message"], counts, error_file, table)


def _file_lines(rows: DataFrame, header: list[dict[str, Any]]) -> DataFrame:
    lines = [(e["row"], e["field"], e["message"]) for e in header]
    return rows.sparkSession.createDataFrame(lines, "row long, field string, message string")


@dataclass(frozen=True)
class FolderImport:
    """`errors`: file, row, field, message. `outcomes`: file, row, outcome, field, message. `files`: file, rows, refused."""

    files: DataFrame
    errors: DataFrame
    outcomes: DataFrame
    table: DataFrame


def import_folder(
    spark: SparkSession,
    folder: str,
    spec: ImportSpec,
    registry: Registry,
    target: DataFrame,
    as_of: datetime,
    tenant: object = None,
    run: str = "run",
    tables: Mapping[str, DataFrame] | None = None,
    expected: DataFrame | None = None,
    max_bytes: int = MAX_FILE_BYTES,
) -> FolderImport:
    """Gate, encoding, parsing, shape, header and rows of every file below a folder, then the merge of what stands.

    A file is refused on its own: a bad one does not stop those beside it. With `abort` one invalid row refuses its file,
    with `skip` only itself. Files with the same columns are validated and merged together, in the order of their names
    and rows; groups of files follow one another by their first names. There are as many groups as different headers.
    """
    entity = registry.get(spec.entity)
    found = inbox.inspect(spark, folder, expected, max_bytes)
    errors, outcomes, counts = [found.problems], [], []
    table = target
    idle = spark.createDataFrame([(p, 0, False) for p in found.idle], f"{FILE} string, rows long, refused boolean")
    refused = [idle, found.problems.select(FILE).distinct().withColumn("rows", F.lit(0).cast("long")).withColumn("refused", F.lit(True))]
    for number, group in enumerate(found.groups):
        mapped = [spec.mappings.get(c, c) for c in group.columns]
        header = validation.header_errors(mapped, entity) if group.kind == "csv" else []
        paths = spark.createDataFrame([(p,) for p in group.paths], f"{FILE} string")
        if header:
            errors += [
                paths.select(FILE, *[F.lit(e[name]).cast(kind).alias(name) for name, kind in (("row", "long"), ("field", "string"), ("message", "string"))])
                for e in header
            ]
            refused.append(paths.select(FILE, F.lit(0).cast("long").alias("rows"), F.lit(True).alias("refused")))
            continue
        checked = keep(validation.validate(rename(group.rows, spec.mappings), entity, ROW, aside=(FILE,)), "folder-validated")
        per_file = keep(
            paths.join(checked.groupBy(FILE).agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col(validation.VALID)).alias("bad")), FILE, "left")
            .select(FILE, F.coalesce("rows", F.lit(0).cast("long")).alias("rows"), F.coalesce("bad", F.lit(0)).alias("bad")),
            "folder-counts",
        )
        empty = per_file.where("rows = 0").select(
            FILE, F.lit(1).cast("long").alias("row"), F.lit(None).cast("string").alias("field"), F.lit(NO_ROWS).alias("message")
        )
        broken = checked.where(~F.col(validation.VALID)).select(FILE, F.explode_outer(validation.ERRORS).alias("e"))
        errors += [empty, broken.select(FILE, "e.row", "e.field", "e.message")]
        stops = F.col("rows") == 0 if spec.on_invalid == "skip" else (F.col("rows") == 0) | (F.col("bad") > 0)
        counts.append(per_file.select(FILE, "rows", stops.alias("refused")))
        good = checked.where(validation.VALID).drop(validation.ERRORS, validation.VALID)
        good = good.join(per_file.where(stops).select(FILE), FILE, "left_anti")
        placed = keep(numbering.number_by_key(good, [FILE, ROW], "__order"), "folder-rows")
        merged = merging.merge(
            table, placed.drop(FILE, ROW), entity, as_of, tenant, spec.mode, spec.match_key, tables, registry, f"{run}-{number}",
            "__order", hold=keep,
        )
        told = merged.outcomes.withColumnRenamed(merging.ROW, "__order").join(placed.select("__order", FILE, ROW), "__order")
        outcomes.append(told.select(FILE, ROW, "outcome", "field", "message"))
        table = keep(merged.table, "folder-table")

    def all_of(parts: list[DataFrame], schema: str) -> DataFrame:
        return reduce(DataFrame.unionByName, parts, spark.createDataFrame([], schema))

    return FolderImport(
        all_of(refused + counts, f"{FILE} string, rows long, refused boolean"), all_of(errors, inbox.PROBLEMS),
        all_of(outcomes, f"{FILE} string, row long, outcome string, field string, message string"), table,
    )
