"""Streaming scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def stream_csv(spark: SparkSession, folder: str, columns: list[str], files_per_batch: int | None = None) -> DataFrame:
    """CSV files as they arrive, oldest first, every value text, empty text to null."""
    reader = (
        spark.readStream.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("enforceSchema", False)
    )
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.csv(folder).select(*[F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) for c in columns])


def stream_parquet(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A parquet table as a stream. `path` is a folder, or one file (read through its folder)."""
    still = spark.read.parquet(path)
    reader = spark.readStream.schema(still.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    folder, _, name = path.rstrip("/").rpartition("/")
    files = still.inputFiles()
    if len(files) == 1 and files[0].endswith(f"{folder}/{name}"):
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def with_event_time(df: DataFrame, ts: str, delay: str = "10 minutes") -> DataFrame:
    """Watermarks need a TIMESTAMP; a TIMESTAMP_NTZ column is read as UTC. Rows later than `delay` are dropped."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
