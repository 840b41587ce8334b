"""Relation joins and lookups (2.E).

All joins are plain equi joins without broadcast hints: Spark broadcasts a side only when its own size
check allows it, and splits a hot key of a shuffled many-to-one join at run time (adaptive skew join).
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from tallyferry.functions.text import blank_to_null
from tallyferry.plans.registry import EntityDef, ForeignKey, Registry
from tallyferry.sources.tables import field_column, foreign_key_column, tenant_rows


def relations_in(entity: EntityDef, paths: Iterable[str]) -> dict[str, list[str]]:
    """Relation -> fields actually used, in declared order; relations no path uses are absent."""
    used: dict[str, set[str]] = {}
    for path in paths:
        head, dot, tail = path.partition(".")
        if dot and entity.relation(head):
            used.setdefault(head, set()).add(tail)
    return {
        r.name: [f.name for f in r.fields if f.name in used[r.name]]
        for r in entity.relations
        if r.name in used
    }


def attach_relations(
    base: DataFrame,
    entity: EntityDef,
    used: Mapping[str, list[str]],
    tables: Mapping[str, DataFrame],
    registry: Registry,
) -> DataFrame:
    """Left join each used relation; its fields become flat columns named `relation.field`.

    Flat columns let Catalyst push a relation filter into the dimension scan. A relation without a
    stored table gives typed nulls. `base` comes from `scan_entity(..., relations=used)`.
    """
    for name, fields in used.items():
        relation = entity.relation(name)
        declared = {f.name: f for f in relation.fields}
        key = foreign_key_column(name)
        if relation.entity not in tables:
            base = base.withColumns({f"{name}.{f}": F.lit(None).cast(declared[f].data_type) for f in fields})
            base = base.drop(key)
            continue
        target = registry.get(relation.entity)
        table = tables[relation.entity]
        joined_key = f"__key_{name}"
        dimension = table.select(
            field_column(table, target, relation.target_key).alias(joined_key),
            *[field_column(table, target, f, declared[f]).alias(f"{name}.{f}") for f in fields],
        )
        base = base.join(dimension, F.col(key) == F.col(joined_key), "left").drop(key, joined_key)
    return base


def nest_relations(df: DataFrame, used: Mapping[str, list[str]]) -> DataFrame:
    """Fold the flat relation columns into one struct per relation, null when nothing matched."""
    for name, fields in used.items():
        flat = [F.col(f"`{name}.{f}`") for f in fields]
        any_value = F.greatest(*[c.isNotNull() for c in flat], F.lit(False))
        record = F.struct(*[c.alias(f) for c, f in zip(flat, fields)])
        df = df.withColumn(name, F.when(any_value, record)).drop(*[f"{name}.{f}" for f in fields])
    return df


def existing(
    keys: DataFrame, table: DataFrame, on: list[str], entity: EntityDef | None = None, tenant: object = None
) -> DataFrame:
    """The keys that are present in the table, or in the tenant's rows of an entity's table."""
    return keys.join(_mine(table, entity, tenant).select(*on), on, "left_semi")


def missing(
    keys: DataFrame, table: DataFrame, on: list[str], entity: EntityDef | None = None, tenant: object = None
) -> DataFrame:
    """The keys that are not present."""
    return keys.join(_mine(table, entity, tenant).select(*on), on, "left_anti")


def _mine(table: DataFrame, entity: EntityDef | None, tenant: object) -> DataFrame:
    return table if entity is None else tenant_rows(table, entity, tenant)


def resolve_foreign_key(
    rows: DataFrame,
    key: ForeignKey,
    tables: Mapping[str, DataFrame],
    registry: Registry,
    tenant: object,
    output: str,
) -> DataFrame:
    """Direct id, else nested object id, else lookup by external id within the tenant, else null."""
    columns = set(rows.columns)
    candidates: list[Column] = []
    if key.column in columns:
        candidates.append(blank_to_null(F.col(key.column).cast("string")))
    if key.nested and key.nested in columns:
        candidates.append(blank_to_null(F.col(f"{key.nested}.id").cast("string")))
    if key.external and key.external in columns and key.entity in tables:
        target = registry.get(key.entity)
        table = tenant_rows(tables[key.entity], target, tenant)
        found = table.select(
            field_column(table, target, "external_id").alias("__external"),
            field_column(table, target, "id").cast("string").alias("__found"),
        ).filter(F.col("__external").isNotNull()).groupBy("__external").agg(F.min("__found").alias("__found"))
        rows = rows.join(found, F.col(key.external) == F.col("__external"), "left").drop("__external")
        candidates.append(F.col("__found"))
    value = F.coalesce(*candidates) if candidates else F.lit(None).cast("string")
    return rows.withColumn(output, value).drop("__found")


def owned_runs(runs: DataFrame, jobs: DataFrame, tenant: Column, tenant_value: object) -> DataFrame:
    """Runs whose job belongs to the tenant."""
    mine = jobs.filter(tenant == F.lit(tenant_value)).select("job_id")
    return runs.join(mine, "job_id", "left_semi")


def cascade_delete(children: DataFrame, deleted: DataFrame, on: str) -> DataFrame:
    """Children that survive when their parents are deleted."""
    return children.join(deleted.select(on), on, "left_anti")
