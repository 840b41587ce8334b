"""Entities as data: fields, relations, required fields, row rules, table binding (2.O, C4, C5, C11, C12, I2).

An `EntityDef` holds everything the operators need, so adding an entity means declaring it, not
writing code. `columns` maps a field to an SQL expression over the stored table; a field without a
stored column is a typed null.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import types as T

# Declared field type -> stored Spark type.
SPARK_TYPES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "number": T.DecimalType(15, 2),
    "integer": T.LongType(),
    "boolean": T.BooleanType(),
    "date": T.TimestampNTZType(),
    "datetime": T.TimestampNTZType(),
    "uuid": T.StringType(),
}


@dataclass(frozen=True)
class FieldDef:
    name: str
    type: str = "string"
    label: str = ""
    required: bool = False
    spark_type: T.DataType | None = None

    def __post_init__(self) -> None:
        if self.type not in SPARK_TYPES:
            raise ValueError(f"Unknown field type '{self.type}' for field '{self.name}'")

    @property
    def data_type(self) -> T.DataType:
        return self.spark_type or SPARK_TYPES[self.type]


@dataclass(frozen=True)
class Relation:
    """A many-to-one link. `foreign_key` is a field of this entity, `target_key` of the other."""

    name: str
    entity: str
    foreign_key: str
    fields: tuple[FieldDef, ...]
    target_key: str = "id"
    type: str = "many_to_one"


@dataclass(frozen=True)
class MergeColumn:
    """How one stored column is filled from an import row.

    `sources` are tried in order and the first non-blank one wins; `update_sources` is the shorter list
    an update looks at, where it differs. On create, `default` applies only
    when none of the sources is a column of the file. `on_update=False` protects the column.
    `unparsed_is_now` writes the import time when a date cannot be read on create.
    """

    name: str
    sources: tuple[str, ...] = ()
    type: str = "string"
    data_type: T.DataType | None = None
    default: object = None
    on_update: bool = True
    unparsed_is_now: bool = False
    update_sources: tuple[str, ...] | None = None

    @property
    def inputs(self) -> tuple[str, ...]:
        return self.sources or (self.name,)

    @property
    def update_inputs(self) -> tuple[str, ...]:
        return self.inputs if self.update_sources is None else self.update_sources

    @property
    def stored_type(self) -> T.DataType:
        return self.data_type or SPARK_TYPES[self.type]


@dataclass(frozen=True)
class ForeignKey:
    """Direct id column, nested object with an id, or a lookup of an external id."""

    column: str
    entity: str
    nested: str | None = None
    external: str | None = None


@dataclass(frozen=True)
class EntityDef:
    name: str
    label: str
    fields: tuple[FieldDef, ...]
    description: str = ""
    relations: tuple[Relation, ...] = ()
    required: tuple[str, ...] = ()
    match_key: str = "external_id"
    id_field: str = "id"
    tenant: str | None = "client_id"
    date_fields: frozenset[str] = frozenset()
    decimal_fields: frozenset[str] = frozenset()
    rules: tuple = ()
    columns: dict[str, str] | None = None
    synonyms: dict[str, str] = field(default_factory=dict)
    default_sort: tuple[tuple[str, str], ...] = ()
    unique_sort: tuple[str, ...] = ("id",)
    overlay: str = "keep"
    merge_columns: tuple[MergeColumn, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()

    def __post_init__(self) -> None:
        if self.overlay not in ("keep", "replace"):
            raise ValueError("overlay is 'keep' or 'replace'")

    def field(self, name: str) -> FieldDef | None:
        return next((f for f in self.fields if f.name == name), None)

    def relation(self, name: str) -> Relation | None:
        return next((r for r in self.relations if r.name == name), None)

    def resolve(self, path: str) -> FieldDef | None:
        """C4: `field` or exactly `relation.field`; anything else is unknown."""
        head, dot, tail = path.partition(".")
        if not dot:
            return self.field(head)
        relation = self.relation(head)
        return relation and next((f for f in relation.fields if f.name == tail), None)

    def check_path(self, path: str) -> FieldDef:
        found = self.resolve(path)
        if found is None:
            raise ValueError(f"Field '{path}' is not allowed for entity '{self.name}'")
        return found

    def allowed_paths(self) -> set[str]:
        """Every simple field and every one-hop relation field."""
        nested = {f"{r.name}.{f.name}" for r in self.relations for f in r.fields}
        return {f.name for f in self.fields} | nested

    def struct_type(self) -> T.StructType:
        return T.StructType(
            [
                T.StructField(f.name, f.data_type, True, {"label": f.label, "required": f.required})
                for f in self.fields
            ]
        )

    def default_fields(self) -> list[dict[str, object]]:
        """Simple fields selected under their label; relation fields offered, not selected."""
        own = [{"field": f.name, "as": f.label, "selected": True} for f in self.fields]
        linked = [
            {"field": f"{r.name}.{f.name}", "as": f"{r.name.capitalize()} {f.label}", "selected": False}
            for r in self.relations
            for f in r.fields
        ]
        return own + linked


class Registry:
    """Q1: the set of known entities."""

    def __init__(self, entities: Iterable[EntityDef] = ()) -> None:
        self._entities: dict[str, EntityDef] = {}
        for entity in entities:
            self.register(entity)

    def register(self, entity: EntityDef) -> EntityDef:
        self._entities[entity.name] = entity
        return entity

    def get(self, name: str) -> EntityDef:
        if name not in self._entities:
            raise KeyError(f"Unknown entity '{name}'")
        return self._entities[name]

    def __contains__(self, name: str) -> bool:
        return name in self._entities

    def __iter__(self):
        return iter(self._entities.values())

    def names(self) -> list[str]:
        return list(self._entities)

    def joins(self) -> dict[tuple[str, str], tuple[str, str]]:
        """(entity, relation) -> (target entity, foreign key)."""
        return {(e.name, r.name): (r.entity, r.foreign_key) for e in self for r in e.relations}

    def check_names(self, declared: Iterable[str]) -> None:
        """Fail fast when the declared entity names and the registry differ either way."""
        declared = set(declared)
        known = set(self._entities)
        if declared != known:
            raise ValueError(
                f"registry mismatch: not registered {sorted(declared - known)}, "
                f"not declared {sorted(known - declared)}"
            )

    def listing(self) -> list[dict[str, object]]:
        """C11: one row per field and per relation field, for a schema page."""
        rows: list[dict[str, object]] = []
        for e in self:
            paths: list[tuple[str, FieldDef]] = [(f.name, f) for f in e.fields]
            paths += [(f"{r.name}.{f.name}", f) for r in e.relations for f in r.fields]
            rows += [
                {"entity": e.name, "path": p, "type": f.type, "label": f.label, "required": f.required}
                for p, f in paths
            ]
        return rows

