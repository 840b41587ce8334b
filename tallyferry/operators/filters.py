"""Filter tree to Column (2.D).

Logic is two-valued: a null field makes any condition false, `ne` included. Wrapping a predicate in
coalesce(..., false) would hide it from the parquet reader, so conditions stay bare as long as only
AND / OR stand above them (a filter drops null and false alike) and are wrapped only below a NOT.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime
from decimal import Decimal, InvalidOperation
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallyferry.functions.numbers import number_text
from tallyferry.functions.dates import as_ntz, is_relative, iso_z, naive_utc, resolve_relative
from tallyferry.plans.specs import Group, Where

# path -> (Column, its Spark type)
Resolver = Callable[[str], tuple[Column, T.DataType]]

_NO_MATCH = object()


def frame_resolver(df: DataFrame) -> Resolver:
    """Paths are column names of `df`; relation fields are flat columns named `relation.field`."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return lambda path: (F.col(f"`{path}`"), types[path])


def as_filter(group: Group | None, resolve: Resolver, as_of: datetime) -> Column:
    """D13-D17 for use in `df.filter`: leaves stay bare where that is safe, so they push down."""
    return F.lit(True) if group is None else _group(group, resolve, as_of, exact=False)


def as_boolean(group: Group | None, resolve: Resolver, as_of: datetime) -> Column:
    """The same tree as a true / false value that is never null, for use in a projection."""
    return F.lit(True) if group is None else _group(group, resolve, as_of, exact=True)


def _group(group: Group, resolve: Resolver, as_of: datetime, exact: bool) -> Column:
    exact = exact or group.operator == "not"
    parts = []
    for child in group.children:
        if isinstance(child, Group):
            parts.append(_group(child, resolve, as_of, exact))
        else:
            column, dtype = resolve(child.field)
            leaf = predicate(column, dtype, child, as_of)
            parts.append(F.coalesce(leaf, F.lit(False)) if exact else leaf)
    if group.operator == "and":
        return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)
    either = reduce(lambda a, b: a | b, parts) if parts else F.lit(False)
    return ~either if group.operator == "not" else either


def predicate(column: Column, dtype: T.DataType, where: Where, as_of: datetime) -> Column:
    """One condition. Null where the field is null."""
    op, value = where.operator, where.value
    if op in ("contains", "ilike", "startswith", "endswith"):
        return _text_predicate(column, dtype, op, str(value))
    if op == "in":
        known = [lit for lit in (literal(v, dtype, as_of) for v in value) if lit is not _NO_MATCH]
        return column.isin(*known) if known else F.lit(False)
    if op == "between":
        low, high = (literal(v, dtype, as_of) for v in value)
        if low is _NO_MATCH or high is _NO_MATCH:
            return F.lit(False)
        if isinstance(dtype, T.StringType) and any(_is_date(v) for v in value):
            column = _text_as_timestamp(column)
        return column.between(low, high)
    lit = literal(value, dtype, as_of)
    if lit is _NO_MATCH:
        # An unknown relative date is false for every operator; any other misfit differs from all values.
        return column.isNotNull() if op == "ne" and not is_relative(value) else F.lit(False)
    if isinstance(dtype, T.StringType) and _is_date(value):
        column = _text_as_timestamp(column)
    return {
        "eq": column.__eq__,
        "ne": column.__ne__,
        "lt": column.__lt__,
        "lte": column.__le__,
        "gt": column.__gt__,
        "gte": column.__ge__,
    }[op](lit)


def _text_predicate(column: Column, dtype: T.DataType, op: str, value: str) -> Column:
    """Text tests see the exported form of a value: plain numbers, ISO text for timestamps, True and False."""
    if isinstance(dtype, T.NumericType):
        column = number_text(column, dtype)
    elif isinstance(dtype, T.BooleanType):
        column = F.initcap(column.cast("string"))
    elif isinstance(dtype, (T.TimestampNTZType, T.TimestampType)):
        column = iso_z(column)
    elif not isinstance(dtype, T.StringType):
        column = column.cast("string")
    if op == "startswith":
        return column.startswith(value)
    if op == "endswith":
        return column.endswith(value)
    return F.contains(F.lower(column), F.lit(value.lower()))


def _is_date(value: Any) -> bool:
    return is_relative(value) or isinstance(value, (date, datetime))


def _text_as_timestamp(column: Column) -> Column:
    """A text field compared with a date is read as ISO text, its zone dropped."""
    return F.regexp_replace(column, r"(Z|[+-]\d{2}:\d{2})$", "").try_cast("timestamp_ntz")


def literal(value: Any, dtype: T.DataType, as_of: datetime) -> Any:
    """The value in the field's own type, or _NO_MATCH if it cannot be one. Never casts rows."""
    if value is None:
        return _NO_MATCH
    if is_relative(value):
        try:
            value = resolve_relative(value, as_of)
        except ValueError:
            return _NO_MATCH
    try:
        if isinstance(dtype, (T.TimestampNTZType, T.TimestampType, T.DateType)):
            return as_ntz(_to_datetime(value))
        if _is_date(value):
            return as_ntz(value) if isinstance(dtype, T.StringType) else _NO_MATCH
        if isinstance(dtype, T.BooleanType):
            return _to_bool(value)
        if isinstance(dtype, T.DecimalType):
            number = Decimal(str(value))
            return F.lit(number) if number.is_finite() else float(number)
        if isinstance(dtype, T.IntegralType):
            if isinstance(value, int):
                return int(value)
            number = float(value)
            return int(number) if number.is_integer() else number
        if isinstance(dtype, T.FractionalType):
            return float(value)
    except (TypeError, ValueError, InvalidOperation, OverflowError):
        return _NO_MATCH
    return str(value) if isinstance(dtype, T.StringType) else _NO_MATCH


def _to_datetime(value: Any) -> datetime:
    if isinstance(value, str):
        value = datetime.fromisoformat(value.replace("Z", "+00:00"))
    if not isinstance(value, date):
        raise TypeError("not a date")
    return naive_utc(value)


def _to_bool(value: Any) -> bool:
    if isinstance(value, str):
        value = {"true": True, "false": False}.get(value.strip().lower())
    if value not in (True, False):
        raise ValueError("not a boolean")
    return bool(value)
