"""Row validation: errors per row, counts, preview, split (2.K, F2, F4, C13).

Everything is a row-local Column expression: no shuffle, no Python, any number of rows. Errors of a
row come in a fixed order: required fields, then the cells in file order, then the entity's own rules.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallyferry.functions import rules, text
from tallyferry.functions.rules import Finding
from tallyferry.plans.registry import EntityDef
from tallyferry.sources.files import ACTION, ROW

ERRORS, VALID = "errors", "is_valid"
_MARKED = "__marked"


def _cells(df: DataFrame, row: str, aside: tuple[str, ...]) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields if f.name not in (row, ACTION, *aside)}


@dataclass(frozen=True)
class _Checks:
    """The findings of a row in reporting order, and the short test that a good row pays for."""

    findings: list[Finding]
    broken: Column

    def gated(self, gate: Column) -> _Checks:
        return _Checks([f.gated(gate) for f in self.findings], gate & self.broken)


def _row_checks(df: DataFrame, entity: EntityDef, row: str, strict: bool, aside: tuple[str, ...]) -> _Checks:
    """K1-K9 for rows that are not deletions; `df` has the column `__marked`."""
    types = _cells(df, row, (*aside, _MARKED))
    cells: Mapping[str, Column] = {name: F.col(f"`{name}`") for name in types}
    findings = rules.required_rules(cells, entity.required)
    plain = list(findings)
    for name, dtype in types.items():
        if isinstance(dtype, T.StringType):
            findings += [f.gated(F.col(_MARKED)) for f in rules.marker_rules(name, cells[name])]
        shape = rules.type_rule(name, cells[name], dtype, strict)
        if shape is not None:
            findings.append(shape)
            plain.append(shape)
    own = [rule.compile(cells) for rule in entity.rules]
    own = [rule for rule in own if rule is not None]
    return _Checks(findings + own, rules.any_of([f.when for f in plain + own] + [F.col(_MARKED)]))


def _with_marks(df: DataFrame, row: str, aside: tuple[str, ...]) -> DataFrame:
    texts = {n: F.col(f"`{n}`") for n, t in _cells(df, row, aside).items() if isinstance(t, T.StringType)}
    return df.withColumn(_MARKED, rules.marked(texts) if texts else F.lit(False))


def _key_finding(df: DataFrame) -> Finding:
    key = F.col("external_id").cast("string") if "external_id" in df.columns else F.lit(None).cast("string")
    return rules.finding("external_id", rules.DELETE_NEEDS_KEY, key.isNull() | (key == ""))


def _action_columns() -> tuple[Column, Column, Column, Finding]:
    """(normal action, something was given, the row is a deletion, unknown-action finding)."""
    raw = F.col(ACTION)
    action = text.normalise_action(raw)
    given = F.coalesce(raw != "", F.lit(False))
    deleting = F.coalesce(action == "delete", F.lit(False))
    return action, given, deleting, rules.finding(ACTION, rules.bad_action_message(raw), given & action.isNull())


def _with_errors(df: DataFrame, row: str, checks: _Checks) -> DataFrame:
    """Add `errors` and `is_valid`.

    Places and flag are one step: they share their conditions, which Spark then puts into methods of
    their own, small enough to be compiled. The lambda that turns places into structs comes after it;
    it reads the places twice, so Spark leaves them where they are.
    """
    spoken = {i: f.message for i, f in enumerate(checks.findings) if f.field == ACTION}
    placed = df.withColumns({"__failed": rules.failed_places(checks.findings), VALID: ~checks.broken})
    errors = rules.errors_at(F.col("__failed"), F.col(row), checks.findings, spoken)
    return placed.withColumn(ERRORS, errors).drop("__failed", _MARKED)


def validate(
    df: DataFrame, entity: EntityDef, row: str = ROW, strict: bool = False, aside: tuple[str, ...] = ()
) -> DataFrame:
    """Add `errors` and `is_valid`.

    With an action column, a deletion needs only its key (K12) and a row with an unknown action reports
    just that (K13). `strict` also refuses NaN, Infinity and days that do not exist.
    """
    marked = _with_marks(df, row, aside)
    checks = _row_checks(marked, entity, row, strict, aside)
    if ACTION in df.columns:
        _, _, deleting, unknown = _action_columns()
        no_key = _key_finding(df).gated(deleting)
        ordinary = checks.gated(~deleting & ~unknown.when)
        checks = _Checks(
            [no_key, unknown, *ordinary.findings], rules.any_of([no_key.when, unknown.when, ordinary.broken])
        )
    return _with_errors(marked, row, checks)


def preview(
    df: DataFrame, entity: EntityDef, row: str = ROW, kind: str = "column", aside: tuple[str, ...] = ()
) -> DataFrame:
    """Row, data, is_valid, errors (row, field, message), and action when there is one.

    Unlike `validate`, a bad or blank action is reported after the row's other errors. `kind` is
    'column' for CSV and 'field' for JSON wording.
    """
    marked = _with_marks(df, row, aside)
    checks = _row_checks(marked, entity, row, False, aside)
    extra: list[Column] = []
    if ACTION in df.columns:
        action, given, deleting, unknown = _action_columns()
        no_key = _key_finding(df).gated(deleting)
        blank = rules.finding(ACTION, rules.ACTION_REQUIRED.format(kind=kind), ~given)
        ordinary = checks.gated(~deleting)
        checks = _Checks(
            [no_key, *ordinary.findings, unknown, blank],
            rules.any_of([no_key.when, ordinary.broken, unknown.when, blank.when]),
        )
        extra = [action.alias("action")]
    return _with_errors(marked, row, checks).select(
        F.col(row).alias(ROW),
        F.struct(*[F.col(f"`{c}`") for c in _cells(df, row, aside)]).alias("data"),
        VALID,
        ERRORS,
        *extra,
    )


def error_rows(validated: DataFrame) -> DataFrame:
    """B4 input: one row per error object."""
    # Good rows have an empty array: kept as a null and dropped afterwards, so that no test of the rows moves below the step
    # that builds the errors, where all conditions would be evaluated once more.
    return validated.select(F.explode_outer(ERRORS).alias("e")).where("e IS NOT NULL").select("e.*")


def summary(validated: DataFrame, header_errors: int = 0) -> DataFrame:
    """One row with total, valid, invalid rows and the number of error objects.

    A header error (K10) counts as one more invalid; so does a file without data rows (K11).
    """
    counted = validated.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(VALID).alias("valid"),
        F.count_if(~F.col(VALID)).alias("invalid"),
        F.coalesce(F.sum(F.size(ERRORS)), F.lit(0)).alias("error_count"),
    )
    added = F.lit(header_errors) + F.when(F.col("total") == 0, 1).otherwise(0)
    return counted.select(
        "total",
        "valid",
        (F.col("invalid") + added).alias("invalid"),
        (F.col("error_count") + added).alias("error_count"),
    )


def header_errors(columns: list[str], entity: EntityDef) -> list[dict[str, object]]:
    """File-level errors seen from the column names alone, after renaming."""
    if not columns:
        return [{"row": 0, "field": None, "message": rules.NO_HEADER}]
    if ACTION in columns:
        return []
    lacking = [name for name in entity.required if name not in columns]
    if not lacking:
        return []
    message = rules.MISSING_COLUMNS.format(fields=", ".join(lacking))
    return [{"row": 0, "field": None, "message": message}]


def missing_columns(required: Column, available: Column) -> Column:
    """I1 as a Column, for a table that describes many files: required minus available."""
    return F.array_except(required, available)


def split(validated: DataFrame, on_invalid: str = "abort") -> tuple[DataFrame, DataFrame]:
    """(rows to import, rows refused).

    `abort` imports nothing as soon as one row is invalid; `skip` leaves only the invalid rows out.
    The abort test is a scalar subquery, so it runs once and is not joined to the rows.
    """
    good, bad = validated.filter(VALID), validated.filter(~F.col(VALID))
    if on_invalid == "skip":
        return good, bad
    bad_rows = bad.agg(F.count(F.lit(1)).alias("n")).scalar()
    return good.filter(bad_rows == 0), bad
