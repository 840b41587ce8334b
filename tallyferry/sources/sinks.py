"""Sinks (2.B): export files, error lines, result records, table snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from tallyferry.sources.files import file_suffix
from tallyferry.sources.tables import serialise


def export_path(root: str, tenant: object, job: str, run: str, fmt: str = "csv") -> str:
    """Where a run's export goes."""
    return f"{root}/exports/{tenant}/{job}/{run}{file_suffix(fmt)}"


def import_error_path(root: str, tenant: object, job: str, run: str, phase: str) -> str:
    """Where a run's error lines go; `phase` is 'validation' or 'import'."""
    return f"{root}/imports/{tenant}/{job}/{run}/{phase}_errors.jsonl"


def write_export(rows: DataFrame, path: str, fmt: str = "csv") -> int:
    """Write the rows and return how many were written, counted by the write itself.

    Columns keep their order and aliases; decimals are written as numbers without exponent and timestamps as
    ISO text with Z (C7); cells keep their blanks. An empty CSV export still gets its header. JSON is one object per line, nulls included,
    so parts can be written and read in parallel.
    """
    rows = serialise(rows, as_text=fmt == "csv")
    written = Observation("written")
    counted = rows.observe(written, F.count(F.lit(1)).alias("n"))
    if fmt == "csv":
        # Without the two space options the writer trims every cell.
        counted.write.mode("overwrite").options(
            header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
        ).csv(path)
    elif fmt == "json":
        counted.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    else:
        raise ValueError(f"Unsupported export format: {fmt}")
    n = written.get["n"]
    if n == 0 and fmt == "csv":
        # Empty partitions write no file; one empty partition writes the header alone.
        rows.limit(0).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return n


def write_errors(errors: DataFrame, path: str) -> None:
    """JSON lines of row, optional field, message."""
    errors.select("row", "field", "message").write.mode("overwrite").json(path)


def export_result(spark: SparkSession, count: int, matched: int, fmt: str, fields: list[str], path: str) -> DataFrame:
    """One row about a finished export."""
    return spark.createDataFrame(
        [(count, matched, fmt, fields, path)],
        "count long, matched long, format string, fields array<string>, remote_file_path string",
    )


def write_snapshot(table: DataFrame, root: str, version: int) -> str:
    """Write a whole new version of a table next to the old one and return its folder.

    Readers of the old version are not disturbed, and a failed write leaves no half-changed table.
    """
    path = f"{root}/version={version}"
    table.write.mode("overwrite").parquet(path)
    return path
