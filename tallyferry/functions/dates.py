"""Date parsing, formatting and relative dates.

Stored dates are naive UTC, i.e. TIMESTAMP_NTZ. Nothing here reads the clock: every function that
needs "now" takes an explicit `as_of`.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, functions as F

# Fixed value: the shape a date cell of an import file must have (shape only, 2024-13-45 passes).
ISO_DATE_SHAPE = r"^\d{4}-\d{2}-\d{2}$"

_LOOSE_DAY = r"^\d{4}-\d{1,2}-\d{1,2}$"
_STAMP = (
    r"^(\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d{1,6})?)?)?)"
    r"(Z|[+-]\d{2}:?\d{2})?$"
)


def as_ntz(value: datetime | date | str) -> Column:
    """A driver-side date as a TIMESTAMP_NTZ literal, so comparisons still push down to parquet."""
    return F.lit(str(naive_utc(value))).cast("timestamp_ntz")


def naive_utc(value: datetime | date | str) -> datetime:
    """J11 on the driver: aware datetimes move to UTC, then the zone is dropped."""
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    if not isinstance(value, datetime):
        return datetime(value.year, value.month, value.day)
    if value.tzinfo is not None:
        value = value.astimezone(timezone.utc).replace(tzinfo=None)
    return value


def has_iso_date_shape(col: Column) -> Column:
    """YYYY-MM-DD by shape."""
    return col.rlike(ISO_DATE_SHAPE)


def parse_day(col: Column) -> Column:
    """J9 helper: a date-only text (one-digit month or day allowed), null if it is not a real day."""
    return F.when(col.rlike(_LOOSE_DAY), col.try_cast("date"))


def parse_timestamp(col: Column) -> Column:
    """ISO date or timestamp text, with or without a zone, to naive UTC; null if unreadable.

    The zone is subtracted as an interval, so the answer does not depend on the session time zone.
    """
    local = F.replace(F.regexp_extract(col, _STAMP, 1), F.lit(","), F.lit(".")).try_cast("timestamp_ntz")
    zone = F.regexp_extract(col, _STAMP, 2)
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    digits = F.replace(zone.substr(F.lit(2), F.length(zone)), F.lit(":"), F.lit(""))
    hours = digits.substr(1, 2).try_cast("int")
    minutes = digits.substr(3, 2).try_cast("int")
    offset = F.make_dt_interval(F.lit(0), sign * hours, sign * minutes, F.lit(0))
    zoned = (zone != "") & (zone != "Z")
    stamp = F.when(zoned, local - offset).otherwise(local)
    return F.coalesce(stamp, parse_day(col).cast("timestamp_ntz"))


def iso_z(col: Column) -> Column:
    """Timestamp to ISO text with a trailing Z; microseconds only when they are not zero."""
    micros = F.date_format(col, "SSSSSS")
    return F.concat(
        F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros)),
        F.lit("Z"),
    )


def seconds_between(start: Column, end: Column) -> Column:
    """Elapsed seconds with fraction, null when either end is null."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return micros / F.lit(1_000_000)


def run_duration(started: Column, completed: Column) -> Column:
    """F8: whole seconds, halves rounded up; null while the run is open."""
    return F.floor(seconds_between(started, completed) + F.lit(0.5)).cast("long")


def relative_age(col: Column, as_of: datetime) -> Column:
    """Just now / n minutes / n hours / n days ago, then the plain date (M/d/yyyy)."""
    seconds = F.floor(seconds_between(col, as_ntz(as_of)))

    def ago(amount: Column, unit: str) -> Column:
        plural = F.when(amount == 1, F.lit("")).otherwise(F.lit("s"))
        return F.concat(amount.cast("string"), F.lit(f" {unit}"), plural, F.lit(" ago"))

    return (
        F.when(seconds < 60, F.lit("just now"))
        .when(seconds < 3600, ago(F.floor(seconds / 60), "minute"))
        .when(seconds < 86400, ago(F.floor(seconds / 3600), "hour"))
        .when(seconds < 7 * 86400, ago(F.floor(seconds / 86400), "day"))
        .otherwise(F.date_format(col, "M/d/yyyy"))
    )


# The relative date names an export filter may use.
ROLLING_DAYS = {"last_7_days": 7, "last_30_days": 30, "last_90_days": 90}
PERIOD_STARTS = ("this_month", "last_month", "this_quarter", "last_quarter", "this_year", "last_year")
RELATIVE_PREFIX = "relative:"


def is_relative(value: object) -> bool:
    return isinstance(value, str) and value.startswith(RELATIVE_PREFIX)


def resolve_relative(value: str, as_of: datetime) -> datetime:
    """Turn `relative:<name>` into a naive datetime. Raises ValueError for an unknown name.

    Rolling names keep the time of day; period names give the first instant of the period.
    """
    name = value.removeprefix(RELATIVE_PREFIX)
    now = naive_utc(as_of)
    if name in ROLLING_DAYS:
        return now - timedelta(days=ROLLING_DAYS[name])
    if name not in PERIOD_STARTS:
        raise ValueError(f"Unknown relative date: {value}")
    which, period = name.split("_")
    months = {"month": 1, "quarter": 3, "year": 12}[period]
    # Count months since year 0, cut down to the period, step back one period for "last".
    index = (now.year * 12 + now.month - 1) // months - (which == "last")
    return datetime(index * months // 12, index * months % 12 + 1, 1)
