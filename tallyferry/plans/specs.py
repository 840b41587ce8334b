"""Export and import specifications, checked and normalised on the driver (2.P).

Nothing here touches rows. Plain dictionaries (as read from JSON) are accepted everywhere.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from tallyferry.functions.dates import is_relative, resolve_relative
from tallyferry.plans.registry import EntityDef

# The predicate language and the import modes.
OPERATORS = (
    "eq", "ne", "lt", "lte", "gt", "gte", "in", "between", "contains", "startswith", "endswith", "ilike",
)
GROUP_OPERATORS = ("and", "or", "not")
IMPORT_MODES = ("create", "update", "upsert")
MAX_EXPORT_ROWS = 100_000
MAX_PREVIEW_ROWS = 100
DEFAULT_PREVIEW_ROWS = 20


@dataclass(frozen=True)
class Where:
    """One condition on a field path."""

    field: str
    operator: str
    value: Any

    def __post_init__(self) -> None:
        if self.operator not in OPERATORS:
            raise ValueError(f"Unknown filter operator '{self.operator}'")
        if self.operator == "between" and not (_is_list(self.value) and len(self.value) == 2):
            raise ValueError("between needs a list of exactly 2 values")
        if self.operator == "in" and not _is_list(self.value):
            raise ValueError("in needs a list of values")


@dataclass(frozen=True)
class Group:
    """and: all children (empty is true); or: any child (empty is false); not: none of them."""

    operator: str = "and"
    children: tuple[Where | Group, ...] = ()

    def __post_init__(self) -> None:
        if self.operator not in GROUP_OPERATORS:
            raise ValueError(f"Unknown group operator '{self.operator}'")

    def paths(self) -> set[str]:
        found: set[str] = set()
        for child in self.children:
            found |= child.paths() if isinstance(child, Group) else {child.field}
        return found


def _is_list(value: object) -> bool:
    return isinstance(value, Sequence) and not isinstance(value, str)


def parse_filter(raw: Any) -> Group | None:
    """Dictionary to filter tree.

    Accepts a group, a single condition without a group (D30), and the map form
    `{field: {"gte": a, "lte": b}}` or `{field: value}` (D31).
    """
    if raw is None or isinstance(raw, Group):
        return raw
    if isinstance(raw, Where):
        return Group("and", (raw,))
    if not isinstance(raw, Mapping):
        raise ValueError("a filter is a dictionary")
    if "field" in raw:
        return Group("and", (Where(raw["field"], raw["operator"], raw.get("value")),))
    if not raw or raw.keys() & {"filters", "groups"} or raw.get("operator") in GROUP_OPERATORS:
        leaves = tuple(Where(f["field"], f["operator"], f.get("value")) for f in raw.get("filters") or ())
        groups = tuple(parse_filter(g) for g in raw.get("groups") or ())
        return Group(raw.get("operator", "and"), leaves + groups)
    leaves = ()
    for path, condition in raw.items():
        pairs = condition.items() if isinstance(condition, Mapping) else (("eq", condition),)
        leaves += tuple(Where(path, op, value) for op, value in pairs)
    return Group("and", leaves)


def check_relative_dates(group: Group, as_of) -> None:
    """Refuse an unknown `relative:` name before any plan is made."""
    for child in group.children:
        if isinstance(child, Group):
            check_relative_dates(child, as_of)
            continue
        values = child.value if _is_list(child.value) else [child.value]
        for value in values:
            if is_relative(value):
                resolve_relative(value, as_of)


@dataclass(frozen=True)
class ExportField:
    field: str
    alias: str | None = None

    @property
    def output(self) -> str:
        return self.field if self.alias is None else self.alias

    @classmethod
    def parse(cls, raw: Any) -> ExportField:
        """A bare string is a field without an alias."""
        if isinstance(raw, cls):
            return raw
        if isinstance(raw, str):
            return cls(raw)
        return cls(raw["field"], raw.get("as"))


@dataclass(frozen=True)
class ExportSpec:
    """What to export. `cap` is the largest limit allowed (H8), None for no cap."""

    entity: str
    fields: tuple[ExportField, ...]
    filters: Group | None = None
    sort: tuple[tuple[str, str], ...] = ()
    limit: int | None = None
    offset: int = 0
    cap: int | None = MAX_EXPORT_ROWS

    def __post_init__(self) -> None:
        if not self.fields:
            raise ValueError("an export needs at least one field")
        if self.limit is not None and (self.limit < 1 or (self.cap is not None and self.limit > self.cap)):
            raise ValueError(f"limit must be between 1 and {self.cap}")
        if self.offset < 0:
            raise ValueError("offset must not be negative")
        for _, direction in self.sort:
            if direction not in ("asc", "desc"):
                raise ValueError("sort direction is 'asc' or 'desc'")

    @classmethod
    def parse(cls, raw: Mapping[str, Any], **overrides: Any) -> ExportSpec:
        sort = tuple(
            (s["field"], s.get("direction", "asc").lower()) if isinstance(s, Mapping) else tuple(s)
            for s in raw.get("sort") or ()
        )
        return cls(
            entity=raw["entity"],
            fields=tuple(ExportField.parse(f) for f in raw["fields"]),
            filters=parse_filter(raw.get("filters")),
            sort=sort,
            limit=raw.get("limit"),
            offset=raw.get("offset", 0),
            **overrides,
        )

    def check(self, entity: EntityDef) -> None:
        """Every selected and filtered path must be declared; sort paths are checked later."""
        for f in self.fields:
            entity.check_path(f.field)
        for path in sorted(self.filters.paths()) if self.filters else ():
            entity.check_path(path)

    def paths(self) -> set[str]:
        filtered = self.filters.paths() if self.filters else set()
        return {f.field for f in self.fields} | filtered | {name for name, _ in self.sort}


@dataclass(frozen=True)
class ImportSpec:
    """How to import. `mappings` renames source columns to target fields."""

    entity: str
    source: str = "file"
    mappings: Mapping[str, str] = field(default_factory=dict)
    mode: str = "create"
    match_key: str = "external_id"
    on_invalid: str = "abort"

    def __post_init__(self) -> None:
        if self.mode not in IMPORT_MODES:
            raise ValueError(f"Unknown import mode '{self.mode}'")
        if self.on_invalid not in ("abort", "skip"):
            raise ValueError("on_invalid is 'abort' or 'skip'")

    @classmethod
    def parse(cls, raw: Mapping[str, Any]) -> ImportSpec:
        return cls(
            entity=raw["entity"],
            source=raw.get("source", "file"),
            mappings={f["source"]: f["target"] for f in raw.get("fields") or ()},
            mode=raw.get("import_mode", "create"),
            match_key=raw.get("match_key", "external_id"),
            on_invalid=(raw.get("options") or {}).get("on_invalid", "abort"),
        )


# What is said when a job lacks its config.
NO_EXPORT_CONFIG = "Export jobs require export_config"
NO_IMPORT_CONFIG = "Import jobs require import_config"


def check_job(job_type: str, export_config: Any, import_config: Any) -> None:
    """The config must fit the job type."""
    if job_type == "export" and not export_config:
        raise ValueError(NO_EXPORT_CONFIG)
    if job_type == "import" and not import_config:
        raise ValueError(NO_IMPORT_CONFIG)


def auto_map(columns: Sequence[str], entity: EntityDef) -> dict[str, str]:
    """Match source columns to fields by name or label, ignoring case, `_` and white space."""

    def squash(name: str) -> str:
        return re.sub(r"[_\s]", "", name.lower())

    found: dict[str, str] = {}
    for column in columns:
        hit = next((f for f in entity.fields if squash(column) in (squash(f.name), squash(f.label))), None)
        if hit:
            found[column] = hit.name
    return found


def parse_literal(value: str) -> Any:
    """Numeric-looking filter text becomes a number."""
    try:
        return int(value)
    except ValueError:
        pass
    try:
        return float(value)
    except ValueError:
        return value
