"""The registered queries and their SQL twins, one module per family.

Each query reads the whole of its tables from `sf_dir`; its SQL twin, where one exists, says the same in
plain SQL over views of those tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

from tallyferry.plans.bindings import TABLES

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query '{name}' is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


class Tables(Mapping[str, DataFrame]):
    """Entity name -> DataFrame, each read only when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")

    def __getitem__(self, entity: str) -> DataFrame:
        return self.raw(TABLES[entity])

    def __contains__(self, entity: object) -> bool:
        return entity in TABLES

    def __iter__(self) -> Iterator[str]:
        return iter(TABLES)

    def __len__(self) -> int:
        return len(TABLES)
