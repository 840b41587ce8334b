"""Number parsing that never throws under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# Spark's own cast also takes a Java suffix ('12.5d'); the guard refuses it. Single underscores
# between digits are allowed, as are the words inf / infinity / nan.
NUMBER_SHAPE = (
    r"(?i)^\s*[+-]?("
    r"\d+(_\d+)*(\.(\d+(_\d+)*)?)?(e[+-]?\d+)?"
    r"|\.\d+(_\d+)*(e[+-]?\d+)?"
    r"|inf|infinity|nan)\s*$"
)


def _clean(col: Column) -> Column:
    return F.when(col.rlike(NUMBER_SHAPE), F.replace(F.trim(col), F.lit("_"), F.lit("")))


def parse_number(col: Column) -> Column:
    """Text to double, null when it is not a number."""
    return _clean(col).try_cast("double")


def parse_decimal(col: Column, precision: int = 15, scale: int = 2) -> Column:
    """Text to decimal, null when it is not a finite number that fits."""
    return _clean(col).try_cast(f"decimal({precision},{scale})")


def number_text(col: Column, dtype: T.DataType) -> Column:
    """A number as exports and text conditions show it: no exponent, no trailing zeros, at least one decimal place.

    Doubles from 1e16 on, or nearer to 0 than 1e-4, keep the exponent form. Integers stay plain.
    """
    if isinstance(dtype, T.IntegralType):
        return col.cast("string")
    if isinstance(dtype, T.DecimalType):
        plain = col if dtype.scale else col.cast(f"decimal({min(dtype.precision + 1, 38)},1)")
    else:
        plain = col.cast("string").try_cast("decimal(38,20)")
    short = F.regexp_replace(plain.cast("string"), r"(\.\d+?)0+$", "$1")
    if isinstance(dtype, T.DecimalType):
        return short
    size = F.abs(col)
    return F.when((size < 1e16) & ((size >= 1e-4) | (size == 0)), short).otherwise(col.cast("string"))


def ceil_div(total: Column, size: int) -> Column:
    """Pages needed for `total` rows of `size` per page, in integer arithmetic."""
    return F.ceil(total / F.lit(size)).cast("long")
