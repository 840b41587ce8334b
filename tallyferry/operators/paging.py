"""Sort, limit, offset, pages and keyset walks (2.H, F1, F6).

A sort always ends in the entity's unique columns. That makes pages disjoint and also lets the range
partitioner split a run of equal leading keys: a third of all rows may share one status.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallyferry.functions.numbers import ceil_div
from tallyferry.operators import numbering

SortKeys = Sequence[tuple[str, str]]

# The first rows of a sort that one task may keep; slices that reach further are cut out of sorted ranges.
TOP_ROWS = 10_000


def sort_columns(sort: SortKeys, unique: Iterable[str] = ()) -> list[Column]:
    """H1-H3: ascending puts nulls last, descending puts them first; then the unique columns."""
    named = [name for name, _ in sort]
    keys = list(sort) + [(name, "asc") for name in unique if name not in named]
    return [
        F.col(f"`{name}`").desc_nulls_first() if direction == "desc" else F.col(f"`{name}`").asc_nulls_last()
        for name, direction in keys
    ]


def known_sort(sort: SortKeys, columns: Iterable[str]) -> list[tuple[str, str]]:
    """H5: drop sort fields that do not exist, with a warning."""
    columns = set(columns)
    for name, _ in sort:
        if name not in columns:
            warnings.warn(f"sort field '{name}' is unknown and ignored", stacklevel=2)
    return [(name, direction) for name, direction in sort if name in columns]


def page_rows(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """H6, H7: a small sorted slice, as previews and pages are; Spark keeps the first offset + limit rows of each task.

    `slice_rows` is for slices of any size.
    """
    ordered = df.orderBy(*order)
    return ordered.offset(offset).limit(limit) if offset else ordered.limit(limit)


def after_row(df: DataFrame, sort: SortKeys, last: Sequence[object]) -> DataFrame:
    """Keyset paging: the rows that follow the row with sort values `last`.

    This is a filter, so page n costs the same as page 1; `sort` must end in unique columns.
    """
    return df.filter(_beyond(df, sort, last))


def _beyond(df: DataFrame, sort: SortKeys, last: Sequence[object]) -> Column:
    past: list[Column] = []
    same: list[Column] = []
    for (name, direction), value in zip(sort, last):
        column = F.col(f"`{name}`")
        if value is None:
            # Nulls are last ascending (nothing follows) and first descending (all values follow).
            beyond = column.isNotNull() if direction == "desc" else F.lit(False)
            equal = column.isNull()
        else:
            target = F.lit(value).cast(df.schema[name].dataType)
            beyond = column < target if direction == "desc" else (column > target) | column.isNull()
            equal = column == target
        past.append(reduce(lambda a, b: a & b, same + [beyond]))
        same.append(equal)
    return F.coalesce(reduce(lambda a, b: a | b, past), F.lit(False))


@dataclass(frozen=True)
class _Edge:
    """A row's sort values, how many rows have the same ones, and how many of these come up to it."""

    values: tuple
    ties: int
    up_to: int

    def same(self, sort: SortKeys) -> Column:
        return reduce(lambda a, b: a & b, [F.col(f"`{n}`").eqNullSafe(F.lit(v)) for (n, _), v in zip(sort, self.values)])


def slice_rows(df: DataFrame, sort: SortKeys, offset: int = 0, limit: int | None = None) -> DataFrame:
    """H6 for offsets and limits of any size: rows offset + 1 to offset + limit, sorted by range partitions.

    The sort keys alone are dealt into sorted ranges and written once; the counts of the ranges say where the slice begins
    and ends, and both rows are looked up there by their places. The slice is then a filter between them. No task keeps
    the first n rows. Rows that agree in all sort columns have no order among them, but as many come as the slice holds.
    """
    order = sort_columns(sort)
    if offset == 0 and limit is None:
        return df.orderBy(*order)
    if limit == 0:
        return df.filter(F.lit(False))
    keys = numbering.ordered(df.select(*[F.col(f"`{name}`") for name, _ in sort]), order)
    sizes = sorted(map(tuple, keys.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()))  # one line per range
    total = sum(n for _, n in sizes)
    if offset >= total:
        return df.filter(F.lit(False))
    first = _edge_at(keys, sort, sizes, offset) if offset else None
    last = _edge_at(keys, sort, sizes, offset + limit) if limit is not None and offset + limit < total else None
    inside, loose = F.lit(True), []
    if first is not None and last is not None and first.values == last.values:
        return df.filter(first.same(sort)).limit(last.up_to - first.up_to)
    if first is not None:
        inside = inside & _beyond(df, sort, first.values)
        if first.up_to < first.ties:
            loose.append(df.filter(first.same(sort)).limit(first.ties - first.up_to))
    if last is not None:
        inside = inside & ~_beyond(df, sort, last.values)
        if last.up_to < last.ties:
            inside = inside & ~last.same(sort)
            loose.append(df.filter(last.same(sort)).limit(last.up_to))
    return reduce(DataFrame.unionByName, [df.filter(inside), *loose]).orderBy(*order)


def _edge_at(keys: DataFrame, sort: SortKeys, sizes: list[tuple[int, int]], n: int) -> _Edge:
    """The n-th row (from 1) of `keys`: its range follows from the sizes, its place there from what comes before."""
    for part, size in sizes:
        if n <= size:
            break
        n -= size
    here = keys.filter(F.col("__part") == part)
    row = here.filter(F.col("__place") == n - 1).select(*[F.col(f"`{name}`") for name, _ in sort]).head()
    found = _Edge(tuple(row), 1, 1)
    # Rows that agree in all sort columns share a range.
    same = here.filter(found.same(sort)).agg(F.count(F.lit(1)).alias("ties"), F.count_if(F.col("__place") < n).alias("up_to")).head()
    return _Edge(tuple(row), same.ties, same.up_to)


def page_number(df: DataFrame, order: list[Column], page: int, page_size: int) -> DataFrame:
    """H9: 1-based page."""
    if page < 1 or page_size < 1:
        raise ValueError("page and page_size start at 1")
    return df.orderBy(*order).offset((page - 1) * page_size).limit(page_size)


def page_totals(df: DataFrame, page_size: int) -> DataFrame:
    """one row with total and total_pages."""
    return df.agg(F.count(F.lit(1)).alias("total")).withColumn(
        "total_pages", ceil_div(F.col("total"), page_size)
    )
