"""Export specification to DataFrame plan (2.A, 2.C, 2.D, 2.E, 2.H)."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from tallyferry.operators import filters, paging
from tallyferry.operators.relations import attach_relations, relations_in
from tallyferry.plans.registry import Registry
from tallyferry.plans.specs import DEFAULT_PREVIEW_ROWS, MAX_PREVIEW_ROWS, ExportSpec, check_relative_dates
from tallyferry.sources.tables import scan_entity


@dataclass(frozen=True)
class Export:
    """A planned export. Nothing has run yet.

    `matching` holds every row that passes the filters (before sort, limit, offset, projection);
    `rows` is the result in requested order with aliases.
    """

    spec: ExportSpec
    matching: DataFrame
    rows: DataFrame

    def matched(self) -> DataFrame:
        """one row, `matched`. No sort and no projection columns are part of this plan."""
        return self.matching.agg(F.count(F.lit(1)).alias("matched"))


def export(
    spec: ExportSpec,
    tables: Mapping[str, DataFrame],
    registry: Registry,
    tenant: object = None,
    as_of: datetime | None = None,
    sorted_output: bool = True,
) -> Export:
    """Plan one export: tenant, needed joins, filters, sort, slice, projection.

    The entity's default order (H10) is used only when a slice needs an order. Pass
    `sorted_output=False` for a bulk export whose sort does not matter: it then has no shuffle. An offset
    that is deep or has no limit runs a lookup of one row while the plan is made.
    """
    entity = registry.get(spec.entity)
    spec.check(entity)
    if spec.filters is not None:
        check_relative_dates(spec.filters, as_of)

    paths = {p for p in spec.paths() if entity.resolve(p)} | set(entity.unique_sort)
    paths |= {name for name, _ in entity.default_sort}
    used = relations_in(entity, paths)
    base = scan_entity(tables[spec.entity], entity, tenant, used)
    wide = attach_relations(base, entity, used, tables, registry)
    matching = wide.filter(filters.as_filter(spec.filters, filters.frame_resolver(wide), as_of))

    sort = paging.known_sort(spec.sort, wide.columns)
    sliced = spec.limit is not None or spec.offset > 0
    if not sort and sliced:
        sort = list(entity.default_sort)
    rows = matching
    if sliced or (sort and sorted_output):
        named = [name for name, _ in sort]
        full = sort + [(name, "asc") for name in entity.unique_sort if name not in named]
        if spec.limit is None or spec.offset + spec.limit > paging.TOP_ROWS:
            rows = paging.slice_rows(matching, full, spec.offset, spec.limit)
        else:
            rows = paging.page_rows(matching, paging.sort_columns(full), spec.limit, spec.offset)
    projected = rows.select(*[F.col(f"`{f.field}`").alias(f.output) for f in spec.fields])
    return Export(spec, matching, projected)


def preview(spec: ExportSpec, *args, limit: int = DEFAULT_PREVIEW_ROWS, **kwargs) -> Export:
    """H7: the first rows only."""
    if not 1 <= limit <= MAX_PREVIEW_ROWS:
        raise ValueError(f"preview limit must be between 1 and {MAX_PREVIEW_ROWS}")
    return export(replace(spec, limit=limit, offset=0), *args, **kwargs)
