"""Entity scans over stored tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallyferry.functions.numbers import number_text
from tallyferry.functions.dates import iso_z
from tallyferry.plans.registry import EntityDef, FieldDef

# Stored column -> the field name it is also known by.
SYNONYMS = {"email_address": "email", "total_amount": "amount", "issue_date": "date"}


def foreign_key_column(relation: str) -> str:
    return f"__fk_{relation}"


def field_column(table: DataFrame, entity: EntityDef, name: str, fallback: FieldDef | None = None) -> Column:
    """Where a field lives in the stored table; a field with no stored column is a typed null."""
    if entity.columns is not None and name in entity.columns:
        return F.expr(entity.columns[name])
    if name in table.columns:
        return F.col(f"`{name}`")
    for stored, alias in {**SYNONYMS, **entity.synonyms}.items():
        if alias == name and stored in table.columns:
            return F.col(f"`{stored}`")
    dtype = fallback.data_type if fallback else T.StringType()
    return F.lit(None).cast(dtype)


def tenant_rows(table: DataFrame, entity: EntityDef, tenant: object) -> DataFrame:
    """The tenant test comes first, straight on the scan, so it prunes partitions or row groups."""
    if tenant is None or entity.tenant is None:
        return table
    return table.filter(F.expr(entity.tenant) == F.lit(tenant))


def scan_entity(
    table: DataFrame, entity: EntityDef, tenant: object = None, relations: Iterable[str] = ()
) -> DataFrame:
    """A5: one column per declared field, plus the key column of each relation about to be joined."""
    columns = [field_column(table, entity, f.name, f).alias(f.name) for f in entity.fields]
    for name in relations:
        relation = entity.relation(name)
        columns.append(field_column(table, entity, relation.foreign_key).alias(foreign_key_column(name)))
    return tenant_rows(table, entity, tenant).select(*columns)


def with_synonyms(df: DataFrame, entity: EntityDef | None = None) -> DataFrame:
    """Add the well-known second names of stored columns, never replacing a real column."""
    pairs = {**SYNONYMS, **(entity.synonyms if entity else {})}
    new = {alias: F.col(stored) for stored, alias in pairs.items() if stored in df.columns and alias not in df.columns}
    return df.withColumns(new) if new else df


def serialise(df: DataFrame, as_text: bool = False) -> DataFrame:
    """Decimals become doubles and timestamps ISO text with Z; other columns stay as they are.

    `as_text` gives the cells of a CSV file: numbers without exponent, True and False.
    """

    def edge(f: T.StructField) -> Column:
        column = F.col(f"`{f.name}`")
        if as_text and isinstance(f.dataType, (T.DecimalType, T.FractionalType)):
            column = number_text(column, f.dataType)
        elif as_text and isinstance(f.dataType, T.BooleanType):
            column = F.initcap(column.cast("string"))
        elif isinstance(f.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)):
            column = iso_z(column)
        return column.alias(f.name)

    return df.select(*[edge(f) for f in df.schema.fields])
