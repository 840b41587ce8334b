"""Many import files at once: what is wrong with each as a whole, what columns it has, and its numbered rows
(A1, A2, A7, A8, K10, K11, K15, K16, K18).

Checks run in the order gate, encoding, parsing, shape; a file that fails one is not looked at by the next. Contents are
read as lines, spread over tasks; only names of files, which Spark's file index holds anyway, and distinct headers come to
the driver. JSON documents are read whole, which the gate bounds (`MAX_FILE_BYTES`).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyferry.functions.rules import NO_HEADER
from tallyferry.session import keep
from tallyferry.sources import files
from tallyferry.sources.files import ACTION, ROW

FILE = "file"
PROBLEMS = "file string, row long, field string, message string"

# The longest cell a CSV file may hold, and what is said of a longer one.
MAX_CELL_CHARS = 131_072
CELL_TOO_LONG = "CSV parsing error: field larger than field limit (131072)"


@dataclass(frozen=True)
class Group:
    """Files of one shape: `rows` has `file`, `row` and the columns; `paths` names the files, those without rows too."""

    kind: str
    columns: list[str]
    paths: list[str]
    rows: DataFrame


@dataclass(frozen=True)
class Inbox:
    """`problems`: file, row, field, message of files refused as a whole. `groups`: the others, but for those in `idle`,
    which are JSON files without a record."""

    problems: DataFrame
    groups: list[Group]
    idle: list[str]


def literal(path: str) -> str:
    """A path as the readers take it: characters of patterns stand for themselves."""
    return "".join(f"\\{c}" if c in r"\[]{}*?" else c for c in path)


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, id (in file order), text of every line that is not empty. Bytes are not decoded: they may not be UTF-8."""
    read = spark.read.text([literal(p) for p in paths])
    return read.select(
        files.plain_path(F.col("_metadata.file_path")).alias(FILE), F.monotonically_increasing_id().alias("id"), "value"
    ).where("value <> ''")


def header_cells(line: Column) -> Column:
    """The cells of a CSV line; quotes are taken off and doubled ones are one."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("(?:[^"]|"")*"|[^,]*)'), 1)
    bare = F.transform(raw, lambda c: F.when(c.startswith('"'), F.replace(F.substring(c, 2, 1 << 30), F.lit('""'), F.lit('"'))).otherwise(c))
    return F.transform(bare, lambda c: F.regexp_replace(c, '"$', ""))


def csv_profiles(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per CSV file with a line: file, header (array), utf8, multiline, longest.

    `multiline` says that some line has an odd number of quotes, so a cell may go on in the next line; all other files can
    be split anywhere between lines. `longest` is the longest line.
    """
    lines = _lines(spark, paths)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    folded = lines.groupBy(FILE).agg(
        F.min_by("value", "id").alias("first"), F.bool_and(F.is_valid_utf8("value")).alias("utf8"),
        F.bool_or(quotes % 2 == 1).alias("multiline"), F.max(F.length("value")).alias("longest"),
    )
    return folded.select(FILE, header_cells(F.col("first")).alias("header"), "utf8", "multiline", "longest")


def _documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, utf8, value of JSON files; each is one row of at most the size the gate allows."""
    read = spark.read.text([literal(p) for p in paths], wholetext=True)
    return read.select(
        files.plain_path(F.col("_metadata.file_path")).alias(FILE), F.is_valid_utf8("value").alias("utf8"),
        F.make_valid_utf8("value").alias("value"),
    )


def _records(documents: DataFrame) -> DataFrame:
    """file, keys of every record that is an object."""
    shape = F.expr("schema_of_variant(doc)")
    parsed = documents.select(FILE, files.parsed_json(F.col("value")).alias("doc"))
    record = F.explode(F.when(shape.startswith("ARRAY"), F.expr("cast(doc AS array<variant>)")).otherwise(F.array("doc")))
    objects = parsed.select(FILE, record.alias("record")).where(F.expr("schema_of_variant(record)").startswith("OBJECT"))
    return objects.select(FILE, F.map_keys(F.expr("cast(record AS map<string, variant>)")).alias("keys"))


def discovered(spark: SparkSession, folder: str) -> DataFrame:
    """File, columns (without the action column), has_action, of every readable file.

    A CSV file has the columns of its header, in order; a JSON file the keys of all its records, sorted.
    """
    found = inspect_names(spark, folder)
    csv = _of_kind(found, ".csv")
    json = _of_kind(found, ".json")
    parts = []
    if csv:
        parts.append(csv_profiles(spark, csv).select(FILE, F.col("header").alias("names")))
    if json:
        keys = _records(_documents(spark, json)).groupBy(FILE).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("keys")))).alias("names"))
        parts.append(keys)
    if not parts:
        return spark.createDataFrame([], f"{FILE} string, columns array<string>, has_action boolean")
    return reduce(DataFrame.unionByName, parts).select(
        FILE, F.array_remove("names", ACTION).alias("columns"), F.array_contains("names", ACTION).alias("has_action")
    )


def inspect_names(spark: SparkSession, folder: str, expected: DataFrame | None = None, max_bytes: int = files.MAX_FILE_BYTES) -> DataFrame:
    """Path, length, message, ok of the files below a folder (hidden ones aside) and of expected ones."""
    listed = files.list_files(spark, folder).where(~F.col("path").rlike(r"/[_.][^/]*$"))
    if expected is not None:
        listed = expected.select("path").join(listed, "path", "full")
    return files.gate_files(listed, None, max_bytes)


def _of_kind(gated: DataFrame, suffix: str) -> list[str]:
    return sorted(r.path for r in gated.where(F.col("ok") & F.lower("path").endswith(suffix)).select("path").collect())


def _said(found: DataFrame, message: str | Column, row: int = 0) -> DataFrame:
    return found.select(
        FILE, F.lit(row).cast("long").alias("row"), F.lit(None).cast("string").alias("field"),
        (F.lit(message) if isinstance(message, str) else message).alias("message"),
    )


def inspect(spark: SparkSession, folder: str, expected: DataFrame | None = None, max_bytes: int = files.MAX_FILE_BYTES) -> Inbox:
    """Every file below a folder, checked as a whole; the rows of those that stand, numbered per file."""
    gated = keep(inspect_names(spark, folder, expected, max_bytes), "inbox-gate")
    problems = [_said(gated.where("NOT ok").withColumnRenamed("path", FILE), F.col("message"))]
    groups: list[Group] = []
    idle: list[str] = []
    if csv := _of_kind(gated, ".csv"):
        profiles = keep(csv_profiles(spark, csv), "inbox-csv")
        problems.append(_said(profiles.where("NOT utf8"), files.BAD_ENCODING))
        names = gated.where(F.col("ok") & F.lower("path").endswith(".csv")).select(F.col("path").alias(FILE))
        problems.append(_said(names.join(profiles, FILE, "left_anti"), NO_HEADER))  # nothing but empty lines
        named = profiles.where("utf8").groupBy("header", "multiline").agg(
            F.sort_array(F.collect_list(FILE)).alias("paths"), F.max("longest").alias("longest")
        )
        for shape in sorted(named.collect(), key=lambda g: g.paths[0]):
            rows = csv_rows(spark, shape.paths, shape.header, shape.multiline)
            paths = list(shape.paths)
            if shape.multiline or shape.longest > MAX_CELL_CHARS:
                widest = F.greatest(F.lit(0), *[F.coalesce(F.length(F.col(f"`{c}`")), F.lit(0)) for c in shape.header])
                wide = keep(rows.groupBy(FILE).agg(F.max(widest).alias("w")).where(F.col("w") > MAX_CELL_CHARS), "inbox-wide")
                problems.append(_said(wide, CELL_TOO_LONG))
                refused = {r[FILE] for r in wide.select(FILE).collect()}
                if refused:
                    paths = [p for p in paths if p not in refused]
                    rows = csv_rows(spark, paths, shape.header, shape.multiline) if paths else rows
            if paths:
                groups.append(Group("csv", list(shape.header), paths, rows))
    if json := _of_kind(gated, ".json"):
        documents = _documents(spark, json)
        problems.append(_said(documents.where("NOT utf8"), files.BAD_ENCODING))
        good = documents.where("utf8").select(FILE, "value")
        shapes = keep(files.json_document_problems(good), "inbox-json")
        problems.append(shapes.select(FILE, "row", F.lit(None).cast("string").alias("field"), "message"))
        whole = good.join(shapes.select(FILE).distinct(), FILE, "left_anti")
        keys = keep(_records(whole).groupBy(FILE).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("keys")))).alias("names")), "inbox-keys")
        idle = sorted(r[FILE] for r in whole.select(FILE).join(keys, FILE, "left_anti").collect())
        named = keys.groupBy("names").agg(F.sort_array(F.collect_list(FILE)).alias("paths"))
        for shape in sorted(named.collect(), key=lambda g: g.paths[0]):
            scanned = files.scan_json(spark, [literal(p) for p in shape.paths], lines=False)
            groups.append(Group("json", list(shape.names), list(shape.paths), _numbered(scanned)))
    groups.sort(key=lambda g: g.paths[0])
    return Inbox(keep(reduce(DataFrame.unionByName, problems), "inbox-problems"), groups, idle)


def csv_rows(spark: SparkSession, paths: list[str], header: list[str], multiline: bool) -> DataFrame:
    """A1, A2: numbered rows of CSV files with one header. Only files with line breaks in cells are read whole."""
    return _numbered(files.scan_csv(spark, [literal(p) for p in paths], multiline, header))


def scan_csv_folder(spark: SparkSession, folder: str) -> DataFrame:
    """A1, A2: all CSV files below a folder, by header name, plain ones split over tasks and others read whole."""
    parts = [
        csv_rows(spark, shape.paths, shape.header, shape.multiline)
        for shape in csv_profiles(spark, _of_kind(inspect_names(spark, folder, max_bytes=1 << 62), ".csv"))
        .groupBy("header", "multiline").agg(F.sort_array(F.collect_list(FILE)).alias("paths")).collect()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _numbered(scanned: DataFrame) -> DataFrame:
    return files.number_rows(scanned, ROW).withColumn(FILE, files.plain_path(F.col(FILE)))
