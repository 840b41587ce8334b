"""CSV / JSON scans, column discovery, file gate, file row numbers."""

from __future__ import annotations

import os
from collections.abc import Mapping
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

ACTION = "_action"
ROW = "row"

# Accepted suffixes and the size limit of one import file.
SUFFIXES = (".csv", ".json")
MAX_FILE_BYTES = 10 * 1024 * 1024
CONTENT_TYPES = {"csv": "text/csv", "json": "application/json"}

# File-level messages.
BAD_SUFFIX = "Invalid file format. Allowed: .csv, .json"
NOT_FOUND = "File not found: {path}"
TOO_LARGE = "File too large. Maximum size: {mb}MB"
EMPTY = "File is empty"
BAD_ENCODING = "File encoding error. File must be UTF-8 encoded"
BAD_JSON = "Invalid JSON"
BAD_TOP_LEVEL = "JSON must be an array or object"
BAD_RECORD = "Record must be an object"

# Up to this many file blocks (about 200 bytes each, 10 MB in all) the block table is broadcast.
_BROADCAST_BLOCKS = 50_000


def file_suffix(fmt: str) -> str:
    """File suffix of an export format, csv when unknown."""
    return f".{fmt.lower()}" if fmt.lower() in CONTENT_TYPES else ".csv"


def content_type(fmt: str) -> str:
    return CONTENT_TYPES.get(fmt.lower(), CONTENT_TYPES["csv"])


def has_quoted_newlines(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether some line has an odd number of quotes, i.e. a cell goes on in the next line. One flag comes to the driver."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return bool(spark.read.text(path).agg(F.bool_or(quotes % 2 == 1)).head()[0])


def scan_csv(
    spark: SparkSession, path: str | list[str], quoted_newlines: bool | None = None, columns: list[str] | None = None
) -> DataFrame:
    """A1, A2: header row, UTF-8, every value text, empty text to null, blank lines skipped.

    Files are split over tasks unless a cell holds a line break; without `quoted_newlines` one pass over the lines finds
    out. Plain and quoted files together are read each in its own way by `inbox.scan_csv_folder`. `columns` gives the
    header when it is known, which saves the look at the first file.
    """
    if quoted_newlines is None:
        quoted_newlines = has_quoted_newlines(spark, path)
    reader = (
        spark.read.option("header", True)
        .option("multiLine", quoted_newlines)
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", "UTF-8")
        .option("mode", "PERMISSIVE")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
        reader = reader.option("enforceSchema", False)
    df = reader.csv(path)
    # Columns taken from folder names may have other types; cells are text.
    cells = {c for c, kind in df.dtypes if kind == "string"}
    return df.select(*[F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) if c in cells else F.col(f"`{c}`") for c in df.columns])


def is_json_lines(spark: SparkSession, path: str) -> bool:
    """Whether the first line that is not blank is an object by itself. Two flags of that line come to the driver."""
    first = F.substring(F.ltrim("value"), 1, 1) == "{"
    seen = spark.read.text(path).where(F.col("value").rlike(r"\S")).select(
        (first & parsed_json(F.when(first, F.col("value"))).isNotNull()).alias("object")
    )
    head = seen.limit(1).head()
    return head is None or head.object


def scan_json(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None, lines: bool | None = None
) -> DataFrame:
    """A3: an array of objects, a single object, or JSON lines; the first line tells which unless `lines` does.
    Without a schema the columns are the union of the keys of all records."""
    if lines is None:
        lines = is_json_lines(spark, path)
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(path)


def scan_file(spark: SparkSession, path: str) -> DataFrame:
    """A4: the reader follows the suffix."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix == ".csv":
        return scan_csv(spark, path)
    if suffix == ".json":
        return scan_json(spark, path)
    raise ValueError(f"Unsupported file format: {suffix}. Supported: .csv, .json")


def discover_columns(df: DataFrame) -> tuple[list[str], bool]:
    """Data columns without the action column, and whether there is one."""
    return [c for c in df.columns if c != ACTION], ACTION in df.columns


def number_rows(df: DataFrame, row: str = ROW, per_file: bool = True) -> DataFrame:
    """A10: 1-based row number in file order for a DataFrame read straight from files.

    Rows of one file block carry consecutive `monotonically_increasing_id`s. One small aggregate gives
    each block's first id and row count; block counts are added up per file, never over the whole
    input, so no task sees all rows. With `per_file` a `file` column is kept, since numbers restart.
    """
    position = df.select(
        "*",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"),
    ).withColumn("__id", F.monotonically_increasing_id())
    blocks = position.groupBy("__file", "__block").agg(
        F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n")
    )
    in_file = Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.sum("__n").over(in_file)
    offsets = blocks.select("__file", "__block", "__first", F.coalesce(earlier, F.lit(0)).alias("__before"))
    # A partition starts at most one block beyond those that begin with a file.
    if len(df.inputFiles()) + df.rdd.getNumPartitions() <= _BROADCAST_BLOCKS:
        offsets = F.broadcast(offsets)
    numbered = position.join(offsets, ["__file", "__block"], "left")
    number = F.col("__before") + F.col("__id") - F.col("__first") + 1
    # A block the aggregate did not see would mean the two scans were split differently.
    number = F.when(F.col("__before").isNull(), F.raise_error(F.lit("file splits changed between passes"))).otherwise(number)
    columns = [F.col(f"`{c}`") for c in df.columns]
    if per_file:
        columns.append(F.col("__file").alias("file"))
    return numbered.select(number.cast("long").alias(row), *columns)


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Path, name and length of every file below a folder; contents are not read.

    The binaryFile reader leaves out files of length zero, so the names come from its file index.
    """
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(folder)
    )
    sizes = listing.select("path", "length")
    # The index gives URIs, in which blanks and the like are escaped; the reader's own column does not.
    names = spark.createDataFrame([(_plain(unquote(f)),) for f in listing.inputFiles()], "path string")
    sizes = sizes.withColumn("path", _plain_column(F.col("path")))
    return names.join(sizes, "path", "left").select("path", F.coalesce("length", F.lit(0)).alias("length"))


def _plain(uri: str) -> str:
    return uri.replace("file:///", "/").removeprefix("file:")


def _plain_column(uri: Column) -> Column:
    return F.regexp_replace(F.replace(uri, F.lit("file:///"), F.lit("/")), "^file:", "")


def plain_path(uri: Column) -> Column:
    """The path in `_metadata.file_path`, whose blanks and the like are escaped."""
    return _plain_column(F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))))


def gate_message(path: Column, length: Column, max_bytes: int = MAX_FILE_BYTES) -> Column:
    """The first failed check of a file, or null. `length` is null when the file is missing."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    return (
        F.when(~suffix.isin(*SUFFIXES), F.lit(BAD_SUFFIX))
        .when(length.isNull(), F.concat(F.lit(NOT_FOUND.format(path="")), path))
        .when(length > max_bytes, F.lit(TOO_LARGE.format(mb=max_bytes / 1024 / 1024)))
        .when(length == 0, F.lit(EMPTY))
    )


def gate_files(files: DataFrame, expected: DataFrame | None = None, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """A8 over many files: path, length, message, ok. `expected` (path) adds files that are missing."""
    if expected is not None:
        files = expected.select("path").join(files, "path", "left")
    message = gate_message(F.col("path"), F.col("length"), max_bytes)
    return files.select("path", "length", message.alias("message"), message.isNull().alias("ok"))


def parsed_json(text: Column) -> Column:
    """The document as a variant, null when it is not one JSON value.

    The parser stops after the first value, so whatever follows would go unseen; inside both brackets and braces nothing
    but one value can stand.
    """
    in_array = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"d":'), text, F.lit("}")))
    return F.when(in_array.isNotNull(), F.variant_get(in_object, "$.d", "variant"))


def json_problems(spark: SparkSession, path: str) -> DataFrame:
    """File, row, message for unreadable JSON, a wrong top level, or a record that is no object."""
    text = spark.read.text(path, wholetext=True)
    return json_document_problems(text.select(F.col("_metadata.file_path").alias("file"), "value"))


def json_document_problems(documents: DataFrame, text: str = "value") -> DataFrame:
    """K15 for JSON documents held in a text column; the other columns identify the document."""
    names = [c for c in documents.columns if c != text]
    parsed = documents.select(*names, parsed_json(F.col(f"`{text}`")).alias("__doc"))
    kind = F.expr("schema_of_variant(__doc)")
    is_array = F.coalesce(kind.startswith("ARRAY"), F.lit(False))
    whole = (
        F.when(F.col("__doc").isNull(), F.lit(BAD_JSON))
        .when(~is_array & ~kind.startswith("OBJECT"), F.lit(BAD_TOP_LEVEL))
    )
    record = F.expr("schema_of_variant(record)")
    of_documents = parsed.select(*names, F.lit(0).cast("long").alias(ROW), whole.alias("message"))
    of_records = (
        parsed.filter(is_array)
        .select(*names, F.posexplode(F.expr("cast(__doc as array<variant>)")).alias("at", "record"))
        .select(
            *names,
            (F.col("at") + 1).cast("long").alias(ROW),
            F.when(~F.coalesce(record.startswith("OBJECT"), F.lit(False)), F.lit(BAD_RECORD)).alias("message"),
        )
    )
    return of_documents.unionByName(of_records).filter(F.col("message").isNotNull())


def encoding_problems(df: DataFrame) -> Column:
    """True when any text cell holds U+FFFD, the mark left by bytes that are not UTF-8."""
    cells = [F.col(f"`{f.name}`") for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return F.greatest(*[F.coalesce(F.contains(c, F.lit("�")), F.lit(False)) for c in cells], F.lit(False))


def rename(df: DataFrame, mappings: Mapping[str, str]) -> DataFrame:
    """Rename mapped columns, keep the others. When two columns get one name the later one wins,
    at the place of the first."""
    chosen: dict[str, str] = {}
    for column in df.columns:
        chosen[mappings.get(column, column)] = column
    return df.select(*[F.col(f"`{source}`").alias(target) for target, source in chosen.items()])
