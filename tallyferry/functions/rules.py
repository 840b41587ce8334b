"""Row rules as Column expressions (2.K).

A `Finding` says what is wrong with a field and when. The standard findings come from `required_rules`
and `cell_rules`; an entity adds its own with `RowRule`.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, functions as F, types as T

from tallyferry.functions import dates, numbers, text

ERROR_TYPE = T.StructType(
    [
        T.StructField("row", T.LongType()),
        T.StructField("field", T.StringType()),
        T.StructField("message", T.StringType()),
    ]
)

# The messages of the standard rules.
REQUIRED = "Required field '{field}' is missing or empty"
SQL_CONTENT = "Potentially malicious content detected in field '{field}'"
SCRIPT_CONTENT = "Potentially malicious script content in field '{field}'"
NOT_A_NUMBER = "Field '{field}' must be a number"
NOT_A_DATE = "Field '{field}' must be in YYYY-MM-DD format"
DELETE_NEEDS_KEY = "external_id is required for DELETE action"
BAD_ACTION_HEAD = "Invalid action '"
BAD_ACTION_TAIL = "'. Use CREATE/C, UPDATE/U, UPSERT/X, or DELETE/D"
ACTION_REQUIRED = "Action is required when _action {kind} is present"
MISSING_COLUMNS = "Missing required fields: {fields}"
NO_HEADER = "CSV file has no header row"
NO_ROWS = "CSV file has no data rows"
AMOUNT_POSITIVE = "Amount must be greater than zero"
DUE_BEFORE_DATE = "Due date cannot be before the bill date"


@dataclass(frozen=True)
class Finding:
    """One possible error of a row; `when` may be null, which means no."""

    field: str
    message: Column
    when: Column

    def gated(self, gate: Column) -> Finding:
        return Finding(self.field, self.message, gate & self.when)


def finding(field: str, message: str | Column, when: Column) -> Finding:
    return Finding(field, F.lit(message) if isinstance(message, str) else message, when)


@dataclass(frozen=True)
class RowRule:
    """K9 / Q2: an entity's own rule. `fails` maps column name -> Column to a boolean Column.

    The rule is left out when one of `needs` is not a column of the file.
    """

    field: str
    message: str
    needs: tuple[str, ...]
    fails: Callable[[Mapping[str, Column]], Column]

    def compile(self, cells: Mapping[str, Column]) -> Finding | None:
        if any(name not in cells for name in self.needs):
            return None
        return finding(self.field, self.message, self.fails(cells))


def _amount_not_positive(cells: Mapping[str, Column]) -> Column:
    # NaN sorts above every number in Spark, so it is not <= 0 and passes, as it should.
    return numbers.parse_number(cells["amount"].cast("string")) <= 0


def _due_before_date(cells: Mapping[str, Column]) -> Column:
    return dates.parse_day(cells["due_date"]) < dates.parse_day(cells["date"])


AMOUNT_IS_POSITIVE = RowRule("amount", AMOUNT_POSITIVE, ("amount",), _amount_not_positive)
DUE_NOT_BEFORE_DATE = RowRule("due_date", DUE_BEFORE_DATE, ("date", "due_date"), _due_before_date)


def required_rules(cells: Mapping[str, Column], required: tuple[str, ...]) -> list[Finding]:
    """K1, in the declared order; a required column the file lacks is a file-level error instead."""
    return [
        finding(name, REQUIRED.format(field=name), text.is_blank(cells[name].cast("string")))
        for name in required
        if name in cells
    ]


def type_rule(name: str, cell: Column, dtype: T.DataType, strict: bool = False) -> Finding | None:
    """K4-K6: the format rule of one column, if it has one.

    `strict` also refuses NaN, Infinity and days that do not exist.
    """
    is_text = isinstance(dtype, T.StringType)
    if name == "amount":
        message = NOT_A_NUMBER.format(field=name)
        if not is_text:
            numeric = isinstance(dtype, (T.NumericType, T.BooleanType))
            return None if numeric else finding(name, message, cell.isNotNull())
        number = numbers.parse_number(cell)
        bad = number.isNull()
        if strict:
            bad = bad | F.isnan(number) | number.isin(float("inf"), float("-inf"))
        return finding(name, message, (cell != "") & bad)
    if name == "date" and is_text:
        bad = ~dates.has_iso_date_shape(cell)
        if strict:
            bad = bad | dates.parse_day(cell).isNull()
        return finding(name, NOT_A_DATE.format(field=name), (cell != "") & bad)
    return None


def marked(cells: Mapping[str, Column]) -> Column:
    """True when any cell holds a marker of K2 or K3.

    One search over all cells joined together, so a good row pays for it once however many columns it
    has. The separator is part of no marker, so none can span two cells.
    """
    joined = F.concat_ws("\u0000", *cells.values())
    return text.contains_any(joined, (*text.SQL_MARKERS, *text.SCRIPT_MARKERS))


def marker_rules(name: str, cell: Column) -> list[Finding]:
    """K2, K3 for one text cell; at most one error of each kind."""
    return [
        finding(name, SQL_CONTENT.format(field=name), text.matches_any(cell, text.SQL_MARKERS)),
        finding(name, SCRIPT_CONTENT.format(field=name), text.matches_any(cell, text.SCRIPT_MARKERS)),
    ]


def any_of(tests: list[Column]) -> Column:
    """True when a test holds; nulls count as no, so the answer is never null."""
    return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests], F.lit(False))


def failed_places(findings: list[Finding]) -> Column:
    """array<int>: the places of the findings that hold, in order.

    Whole numbers instead of structs keep the generated code small, and no lambda is involved: lambdas
    run outside generated code and would take every rule with them.
    """
    places = [F.when(f.when, F.lit(i)) for i, f in enumerate(findings)]
    return F.array_except(F.array(*places), F.array(F.lit(None).cast("int")))


def errors_at(places: Column, row: Column, findings: list[Finding], spoken: Mapping[int, Column]) -> Column:
    """array<struct<row, field, message>> for failed places. `spoken` holds messages that quote the row."""
    table = F.array(*[F.struct(F.lit(f.field).alias("field"), f.message.alias("message")) if i not in spoken
                      else F.struct(F.lit(f.field).alias("field"), F.lit(None).cast("string").alias("message"))
                      for i, f in enumerate(findings)])

    def describe(i: Column) -> Column:
        message = table[i]["message"]
        for place, said in spoken.items():
            message = F.when(i == place, said).otherwise(message)
        return F.struct(
            row.cast("long").alias("row"), table[i]["field"].alias("field"), message.alias("message")
        )

    return F.when(F.size(places) > 0, F.transform(places, describe)).otherwise(
        F.array().cast(T.ArrayType(ERROR_TYPE))
    )


def bad_action_message(raw: Column) -> Column:
    return F.concat(F.lit(BAD_ACTION_HEAD), raw, F.lit(BAD_ACTION_TAIL))
