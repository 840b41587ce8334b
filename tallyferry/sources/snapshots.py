"""A table as parquet partitioned by key bucket, so that a merge reads and rewrites only what it touches.

Writes are Spark's dynamic partition overwrite; nothing else keeps book of files. A batch of changes first writes its result
beside the table and marks it whole, then overwrites the touched partitions from there. A batch that runs again after a
failure finds its mark and only repeats the overwrite, or finds none and an untouched table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

BUCKET, LIVE = "bucket", "live"


@dataclass(frozen=True)
class PartitionedTable:
    """Rows with a key lie in the bucket of its hash. Rows without one are only ever added: those of a batch lie in a partition
    of its own, numbered after the buckets."""

    spark: SparkSession
    root: str
    schema: T.StructType
    key: str = "external_id"
    buckets: int = 64

    @property
    def path(self) -> str:
        return f"{self.root}/rows"

    def bucket(self, batch: int) -> Column:
        hashed = F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")
        return F.when(F.col(self.key).isNotNull(), hashed).otherwise(F.lit(self.buckets + batch)).alias(BUCKET)

    def create(self, rows: DataFrame) -> None:
        self._write(rows.withColumn(LIVE, F.lit(True)).withColumn(BUCKET, self.bucket(0)), self.path)

    def touched(self, keys: DataFrame) -> list[int]:
        """Buckets that the given values of the key column fall into: at most `buckets` numbers."""
        given = keys.where(F.col(self.key).isNotNull()).select(self.bucket(0)).distinct()
        return sorted(r[BUCKET] for r in given.collect())

    def read(self, only: Iterable[int] | None = None) -> DataFrame:
        """The rows of all partitions or, by partition pruning, of some buckets."""
        rows = self._stored(self.path)
        if only is not None:
            rows = rows.where(F.col(BUCKET).isin(list(only)))
        return rows.where(LIVE).select(*self.schema.names)

    def change(self, batch: int, touched: list[int], make: Callable[[DataFrame], DataFrame]) -> None:
        """Replace the touched buckets by `make`(their rows), and add what has no key. `batch` counts from 1.

        Batches come one after another; one that runs again must be the last one.
        """
        staged, mark = f"{self.root}/staged/batch={batch}", f"{self.root}/whole/batch={batch}"
        if not self._marked(mark):
            made = make(self.read(touched)).withColumn(LIVE, F.lit(True)).withColumn(BUCKET, self.bucket(batch))
            # A bucket that lost all its rows is written too: by a row that nobody reads.
            empty = self.spark.createDataFrame([(b, False) for b in touched], f"{BUCKET} int, {LIVE} boolean")
            self._write(made.unionByName(empty, allowMissingColumns=True), staged)
            self.spark.range(1).write.mode("overwrite").parquet(mark)
        self._write(self._stored(staged), self.path)

    def _write(self, rows: DataFrame, path: str) -> None:
        # Few files per bucket; a rebalance, unlike a repartition, splits a bucket that is too large for one task.
        rows.hint("rebalance", BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)

    def _stored(self, path: str) -> DataFrame:
        fields = [T.StructField(f.name, f.dataType) for f in self.schema.fields]
        schema = T.StructType([*fields, T.StructField(LIVE, T.BooleanType()), T.StructField(BUCKET, T.IntegerType())])
        return self.spark.read.schema(schema).parquet(path)

    def _marked(self, path: str) -> bool:
        try:
            return not self.spark.read.schema("id long").parquet(path).isEmpty()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return False
