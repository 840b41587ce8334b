"""Keyed merge of import rows into a tenant's table, in file order (2.L).

A row must see the effect of earlier rows with the same key: a create after a delete succeeds, a second
create fails. Each row's only state is "does the key exist now", which is the last create / delete
signal before it. So:

1. classify rows on their own (action, required fields, key present);
2. find `exists` for each row with one window by key; keys that hold more than `hot_rows` rows are cut by
   rank into chunks of that size instead, and the last signal of a chunk is carried forward;
3. fold the effective rows of a key into one delta with plain aggregates (partial sums before the
   shuffle, no group is ever collected);
4. apply deltas to the table with one left join. Rows without a key never meet the window.

Row numbers are unique and start at 1. Nothing reads the clock or draws random ids, so a lost task
gives the same rows again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tallyferry.functions import ids, numbers, text
from tallyferry.functions.dates import as_ntz, parse_timestamp
from tallyferry.functions.rules import REQUIRED
from tallyferry.operators import numbering, uniqueness
from tallyferry.operators.relations import resolve_foreign_key
from tallyferry.plans.registry import EntityDef, MergeColumn, Registry
from tallyferry.plans.specs import IMPORT_MODES
from tallyferry.session import keep
from tallyferry.sources.files import ACTION, ROW

CREATED, UPDATED, DELETED, SKIPPED, FAILED = "created", "updated", "deleted", "skipped", "failed"
OUTCOMES = (CREATED, UPDATED, DELETED, SKIPPED, FAILED)

# The messages of failed merge rows.
INVALID_ACTION = "Invalid action '"
KEY_FOR_DELETE = "Match key '{key}' required for DELETE"
KEY_FOR_UPDATE = "Match key '{key}' is required for UPDATE mode"
KEY_EXISTS = "Record with {key}='"
BAD_VALUE = "Failed to import record: invalid value for '{field}'"

HOT_ROWS = 1_000_000


@dataclass(frozen=True)
class Merge:
    """`table` is the new table; `outcomes` has one line per import row (row, outcome, field, message)."""

    table: DataFrame
    outcomes: DataFrame


def merge(
    target: DataFrame,
    changes: DataFrame,
    entity: EntityDef,
    as_of: datetime,
    tenant: object = None,
    mode: str = "create",
    match_key: str | None = None,
    tables: Mapping[str, DataFrame] | None = None,
    registry: Registry | None = None,
    run_id: str = "",
    row: str = ROW,
    hot_rows: int | None = HOT_ROWS,
    unique_keys: bool = False,
    outcomes_only: bool = False,
    hold: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> Merge:
    """M1-M19. `target` is the stored table (all tenants), `changes` the renamed import rows.

    `unique_keys` promises at most one row per key and replaces the window by a plain lookup.
    `hot_rows=None` promises that no key is hot and saves the pass that looks for hot keys, which runs at once.
    `outcomes_only` says that the new table will not be used.
    `hold` may write intermediate rows down (`session.keep`): the classified rows are read by several
    passes, the applied rows by the outcomes and three times by the new table. Without it each pass
    reads the changes again.
    """
    key = match_key or entity.match_key
    if mode not in IMPORT_MODES:
        raise ValueError(f"Unknown import mode '{mode}'")
    if key != entity.id_field and key not in {m.name for m in entity.merge_columns}:
        raise ValueError(f"'{key}' is not a match key of entity '{entity.name}'")

    staged = hold(_classify(
        _with_foreign_keys(changes, entity, tables or {}, registry, tenant), entity, mode, key, row, _uuid_links(entity, registry)
    ))
    known = _table_keys(target, entity, key, tenant)
    keyed = _exists_by_lookup(staged, known) if unique_keys else _exists_in_order(staged, known, hot_rows)
    applied = _apply(keyed, entity, key, as_of)
    if key == entity.id_field and entity.match_key != key and entity.match_key in {m.name for m in entity.merge_columns}:
        applied = _refuse_taken(hold(applied), target, entity, tenant, hot_rows)
    if not outcomes_only:
        applied = hold(applied)
    table = _new_table(target, applied, entity, key, as_of, tenant, run_id)
    return Merge(table, applied.select(F.col("__row").alias(ROW), "outcome", "field", "message"))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """One row with the five counts and the total."""
    counts = {"imported": CREATED, "updated": UPDATED, "deleted": DELETED, "skipped": SKIPPED, "failed": FAILED}
    return outcomes.agg(
        *[F.count_if(F.col("outcome") == word).alias(f"{name}_count") for name, word in counts.items()],
        F.count(F.lit(1)).alias("total_rows"),
    )


def run_status(counts: DataFrame) -> DataFrame:
    """succeeded when nothing failed, else failed with the number of failed records."""
    failed = F.col("failed_count")
    return counts.withColumn("status", F.when(failed == 0, "succeeded").otherwise("failed")).withColumn(
        "error_message", F.when(failed > 0, F.concat(failed.cast("string"), F.lit(" records failed to import")))
    )


def duplicate_keys(table: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once; null keys are free."""
    given = table.dropna(subset=keys)
    return given.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


# -- step 1: each row on its own ---------------------------------------------------------------------


def _with_foreign_keys(changes, entity, tables, registry, tenant) -> DataFrame:
    for fk in entity.foreign_keys:
        changes = resolve_foreign_key(changes, fk, tables, registry, tenant, f"__fk_{fk.column}")
    return changes


def _as_text(df: DataFrame, name: str) -> Column:
    dtype = df.schema[name].dataType
    column = F.col(f"`{name}`")
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(column)
    return column.cast("string")


def _key_text(df: DataFrame, entity: EntityDef, key: str) -> Column:
    """The key as it is compared, null when absent; an unreadable uuid matches nothing."""
    if key not in df.columns:
        return F.lit(None).cast("string")
    raw = text.blank_to_null(_as_text(df, key))
    field = entity.field(key)
    return ids.parse_uuid(raw) if field is not None and field.type == "uuid" else raw


def _uuid_links(entity: EntityDef, registry: Registry | None) -> list[str]:
    """Foreign key columns whose direct value must be a uuid, because the other entity's id is one."""
    if registry is None:
        return []
    others = [(fk.column, registry.get(fk.entity)) for fk in entity.foreign_keys]
    return [column for column, other in others if (own := other.field(other.id_field)) is not None and own.type == "uuid"]


def _classify(
    changes: DataFrame, entity: EntityDef, mode: str, key: str, row: str, uuid_links: Iterable[str] = ()
) -> DataFrame:
    raw_key = text.blank_to_null(_as_text(changes, key)) if key in changes.columns else F.lit(None).cast("string")
    has_action = ACTION in changes.columns
    staged = changes.withColumns(
        {
            "__row": F.col(row).cast("long"),
            "__action": text.normalise_action(F.col(ACTION)) if has_action else F.lit(mode),
            "__raw_key": raw_key,
        }
    )
    action, given_key = F.col("__action"), F.col("__raw_key")
    deleting = action == "delete"
    # (test, field, message) in the order in which they are looked at; the first that holds counts.
    failures: list[tuple[Column, str, Column]] = []
    if has_action:
        shown = F.coalesce(text.blank_to_null(F.col(ACTION)), F.lit("None"))
        failures.append((action.isNull(), ACTION, F.concat(F.lit(INVALID_ACTION), shown, F.lit("'"))))
    failures.append((deleting & given_key.isNull(), key, F.lit(KEY_FOR_DELETE.format(key=key))))
    for name in entity.required:
        lacking = text.is_blank(_as_text(changes, name)) if name in changes.columns else F.lit(True)
        failures.append((~deleting & lacking, name, F.lit(REQUIRED.format(field=name))))
    failures.append(((action == "update") & text.is_blank(given_key), key, F.lit(KEY_FOR_UPDATE.format(key=key))))

    bad_values = []
    for column in entity.merge_columns:
        # A date that cannot be read may stand for the time of the import; any other value has to be readable.
        if not isinstance(column.stored_type, T.StringType) and not column.unparsed_is_now:
            raw = _first_given(changes, column.inputs)
            bad_values.append((~deleting & raw.isNotNull() & _parse(raw, column).isNull(), F.lit(column.name)))
    for name in uuid_links:
        if name in changes.columns:
            raw = text.blank_to_null(_as_text(changes, name))
            bad_values.append((~deleting & raw.isNotNull() & ids.parse_uuid(raw).isNull(), F.lit(name)))
    # Each step reads the one before it several times, so Spark computes it once and keeps it apart.
    staged = staged.withColumns(
        {
            "__fail": _first_of([(test, F.lit(i)) for i, (test, _, _) in enumerate(failures)], "int"),
            "__bad_field": _first_of(bad_values, "string"),
        }
    )
    fail = F.col("__fail")
    staged = staged.withColumns(
        {
            "__fail_field": _first_of([(fail == i, F.lit(name)) for i, (_, name, _) in enumerate(failures)], "string"),
            "__fail_message": _first_of([(fail == i, said) for i, (_, _, said) in enumerate(failures)], "string"),
            "__key": F.when(fail.isNull(), _key_text(changes, entity, key)),
        }
    ).drop("__fail")
    # With the id as key a created row gets a fresh id, so it does not make the given value exist.
    creates = F.lit(False) if key == entity.id_field else action.isin("create", "upsert")
    signal = F.when(deleting, False).when(creates & F.col("__bad_field").isNull(), True)
    return staged.withColumn("__signal", F.when(F.col("__key").isNotNull(), signal))


def _first_of(choices: list[tuple[Column, Column]], kind: str) -> Column:
    """The value of the first test that holds, as one flat CASE."""
    if not choices:
        return F.lit(None).cast(kind)
    (test, value), *rest = choices
    chain = F.when(test, value)
    for test, value in rest:
        chain = chain.when(test, value)
    return chain


# -- step 2: does the key exist when the row is applied -----------------------------------------------


def _table_keys(target: DataFrame, entity: EntityDef, key: str, tenant: object) -> DataFrame:
    """Only the key column of the tenant's rows is read here."""
    mine = target if tenant is None or entity.tenant is None else target.filter(F.expr(entity.tenant) == F.lit(tenant))
    return mine.select(F.col(key).cast("string").alias("__key")).filter(F.col("__key").isNotNull())


def _exists_by_lookup(staged: DataFrame, known: DataFrame) -> DataFrame:
    found = known.distinct().withColumn("__exists", F.lit(True))
    return staged.join(found, "__key", "left").withColumn("__exists", F.coalesce("__exists", F.lit(False)))


def _exists_in_order(staged: DataFrame, known: DataFrame, hot_rows: int | None) -> DataFrame:
    # Rows without a key have no state and take no part in any shuffle here.
    loose = staged.filter(F.col("__key").isNull()).withColumn("__exists", F.lit(False))
    own = staged.filter(F.col("__key").isNotNull())
    touched = own.groupBy("__key").agg(F.count(F.lit(1)).alias("__n"))
    # Existing keys enter as a row 0 that says "exists".
    base = known.join(touched, "__key", "left_semi").select(
        "__key", F.lit(0).cast("long").alias("__row"), F.lit(True).alias("__signal"), F.lit(True).alias("__base")
    )
    rows = own.withColumn("__base", F.lit(False)).unionByName(base, allowMissingColumns=True)
    if hot_rows is None:
        return _exists_in_window(rows).unionByName(loose)
    # Each of these keys owns more than hot_rows rows, so there are fewer than rows / hot_rows of them.
    hot = keep(touched.filter(F.col("__n") > hot_rows).select("__key"), "hot-keys")
    if hot.isEmpty():
        return _exists_in_window(rows).unionByName(loose)
    cold = _exists_in_window(rows.join(hot, "__key", "left_anti"))
    # Only key, row and signal of hot keys are dealt out; the other columns come back by row number.
    signals = rows.join(hot, "__key", "left_semi").select("__key", "__row", "__signal", "__base")
    chunks = numbering.in_chunks(signals, "__key", "__row", hot_rows)
    states = numbering.last_before(chunks, "__key", "__row", "__signal", "__exists").filter(~F.col("__base")).select(
        "__row", F.coalesce("__exists", F.lit(False)).alias("__exists")
    )
    busy = own.join(hot, "__key", "left_semi").join(states, "__row")
    return cold.unionByName(busy).unionByName(loose)


def _exists_in_window(rows: DataFrame) -> DataFrame:
    """One window by key: the last signal before each row."""
    before = Window.partitionBy("__key").orderBy("__row").rowsBetween(Window.unboundedPreceding, -1)
    state = F.coalesce(F.last("__signal", ignorenulls=True).over(before), F.lit(False))
    return rows.withColumn("__exists", state).filter(~F.col("__base")).drop("__base")


# -- steps 3 and 4 ------------------------------------------------------------------------------------


def _first_given(df: DataFrame, names) -> Column:
    found = [text.blank_to_null(_as_text(df, n)) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def _parse(raw: Column, column: MergeColumn) -> Column:
    kind = column.stored_type
    if isinstance(kind, T.DecimalType):
        return numbers.parse_decimal(raw, kind.precision, kind.scale)
    if isinstance(kind, T.NumericType):
        return numbers.parse_number(raw).cast(kind) if isinstance(kind, T.FractionalType) else raw.try_cast(kind)
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        return parse_timestamp(raw)
    return raw if isinstance(kind, T.StringType) else raw.try_cast(kind)


def _apply(rows: DataFrame, entity: EntityDef, key: str, as_of: datetime) -> DataFrame:
    """Outcome of every row, and per table column a struct<v> or null when not given."""
    action, exists = F.col("__action"), F.col("__exists")
    rows = rows.withColumn(
        "__plain",
        F.when(F.col("__fail_message").isNotNull(), F.lit(FAILED))
        .when(action == "delete", F.when(exists, F.lit(DELETED)).otherwise(F.lit(SKIPPED)))
        .when(action == "create", F.when(exists, F.lit(FAILED)).otherwise(F.lit(CREATED)))
        .when(action == "update", F.when(exists, F.lit(UPDATED)).otherwise(F.lit(SKIPPED)))
        .otherwise(F.when(exists, F.lit(UPDATED)).otherwise(F.lit(CREATED))),
    )
    plain = F.col("__plain")
    bad = F.col("__bad_field").isNotNull() & plain.isin(CREATED, UPDATED)
    clash = F.concat(F.lit(KEY_EXISTS.format(key=key)), F.col("__raw_key"), F.lit("' already exists"))
    head, tail = BAD_VALUE.split("{field}")
    bad_text = F.concat(F.lit(head), F.col("__bad_field"), F.lit(tail))
    rows = rows.withColumns(
        {
            "outcome": F.when(bad, F.lit(FAILED)).otherwise(plain),
            "field": F.coalesce("__fail_field", F.when(bad, F.col("__bad_field"))),
            "message": F.coalesce("__fail_message", F.when(bad, bad_text), F.when(plain == FAILED, clash)),
        }
    )
    created, updated = F.col("outcome") == CREATED, F.col("outcome") == UPDATED
    cells = []
    for column in entity.merge_columns:
        cell = F.when(created, F.struct(_create_value(rows, column, as_of).alias("v")))
        names = [n for n in column.update_inputs if n in rows.columns]
        if names and column.on_update and column.name != key:
            raw = _first_given(rows, names)
            given = updated if entity.overlay == "replace" else updated & raw.isNotNull()
            cell = cell.when(given, F.struct(_parse(raw, column).alias("v")))
        cells.append(cell.alias(f"c_{column.name}"))
    for fk in entity.foreign_keys:
        value = F.col(f"__fk_{fk.column}")
        given = created | (updated & value.isNotNull())
        cells.append(F.when(given, F.struct(value.alias("v"))).alias(f"c_{fk.column}"))
    return rows.select("__row", "__key", "outcome", "field", "message", *cells)


def _refuse_taken(applied: DataFrame, target: DataFrame, entity: EntityDef, tenant: object, hot_rows: int | None) -> DataFrame:
    """Merged by id, a row fails if it would take the match key of another row of the tenant's table."""
    unique, cell = entity.match_key, F.col(f"c_{entity.match_key}")
    outcome = F.col("outcome")
    # A created row has a fresh id, which no later row can name.
    who = F.when(outcome == CREATED, F.concat(F.lit("row "), F.col("__row"))).otherwise(F.concat(F.lit("id "), F.col("__key")))
    claims = applied.filter(outcome.isin(CREATED, UPDATED) & cell.isNotNull()).select(
        F.col("__row").alias("at"), who.alias("who"), cell["v"].cast("string").alias("value"), F.lit(True).alias("claims")
    )
    ends = applied.filter(outcome == DELETED).select(
        F.col("__row").alias("at"), who.alias("who"), F.lit(None).cast("string").alias("value"), F.lit(False).alias("claims")
    )
    mine = target if tenant is None or entity.tenant is None else target.filter(F.expr(entity.tenant) == F.lit(tenant))
    stored = mine.select(
        F.lit(0).cast("long").alias("at"), F.concat(F.lit("id "), F.col(entity.id_field).cast("string")).alias("who"),
        F.col(unique).cast("string").alias("value"), F.lit(False).alias("claims"),
    ).filter("value IS NOT NULL")
    changed = claims.unionByName(ends)
    # Only stored rows that are named by a change or hold a claimed value matter.
    wanted = claims.select("value").distinct()
    named = stored.join(changed.select("who").distinct(), "who", "left_semi")
    others = stored.join(changed.select("who").distinct(), "who", "left_anti").join(wanted, "value", "left_semi")
    events = changed.unionByName(named).unionByName(others)
    refused = uniqueness.refused_claims(events, hot_rows or uniqueness.CHUNK).select(
        F.col("at").alias("__row"), F.lit(True).alias("__taken")
    )
    judged = applied.join(refused, "__row", "left")
    taken = F.coalesce("__taken", F.lit(False))
    said = F.concat(F.lit(KEY_EXISTS.format(key=unique)), cell["v"].cast("string"), F.lit("' already exists"))
    cells = [c for c in applied.columns if c.startswith("c_")]
    return judged.select(
        "__row", "__key", F.when(taken, F.lit(FAILED)).otherwise(outcome).alias("outcome"),
        F.when(taken, F.lit(unique)).otherwise(F.col("field")).alias("field"), F.when(taken, said).otherwise(F.col("message")).alias("message"),
        *[F.when(~taken, F.col(c)).alias(c) for c in cells],
    )


def _create_value(df: DataFrame, column: MergeColumn, as_of: datetime) -> Column:
    """A default fills in only for a column the file does not have."""
    names = [n for n in column.inputs if n in df.columns]
    if not names:
        value = F.lit(column.default).cast(column.stored_type)
    else:
        value = _parse(_first_given(df, names), column)
    return F.coalesce(value, as_ntz(as_of)) if column.unparsed_is_now else value


def _new_table(target, applied, entity, key, as_of, tenant, run_id) -> DataFrame:
    columns = [m.name for m in entity.merge_columns] + [fk.column for fk in entity.foreign_keys]
    outcome, at = F.col("outcome"), F.col("__row")
    alone = F.col("__key").isNull() | F.lit(key == entity.id_field)
    fresh = applied.filter((outcome == CREATED) & alone)

    starts = outcome.isin(CREATED, DELETED)
    effective = applied.filter(outcome.isin(CREATED, UPDATED, DELETED) & F.col("__key").isNotNull())
    if key == entity.id_field:
        effective = effective.filter(outcome != CREATED)
    last_cells = [
        F.max_by(F.when(F.col(f"c_{c}").isNotNull(), F.struct(at.alias("at"), F.col(f"c_{c}.v").alias("v"))),
                 F.when(F.col(f"c_{c}").isNotNull(), at)).alias(f"c_{c}")
        for c in columns
    ]
    delta = effective.groupBy("__key").agg(
        F.max(F.when(starts, at)).alias("__start"),
        F.max_by(outcome, F.when(starts, at)).alias("__start_kind"),
        F.max(F.when(outcome == UPDATED, at)).alias("__update"),
        *last_cells,
    )
    # A value counts only if it was set in the key's last life, i.e. not before its last create or delete.
    delta = delta.withColumns(
        {f"c_{c}": F.when(F.col("__start").isNull() | (F.col(f"c_{c}.at") >= F.col("__start")), F.col(f"c_{c}")) for c in columns}
    )

    kept = _overlay(target, delta, entity, key, columns, as_of, tenant)
    reborn = delta.filter(F.col("__start_kind") == CREATED).withColumnRenamed("__start", "__born")
    born = [reborn, fresh.withColumnRenamed("__row", "__born")]
    new = [_as_table_rows(df, target, entity, columns, as_of, tenant, run_id) for df in born]
    return kept.unionByName(new[0]).unionByName(new[1])


def _overlay(target, delta, entity, key, columns, as_of, tenant) -> DataFrame:
    """The table's own rows: patched where a delta updates them, dropped where it deletes them."""
    patch = delta.select(
        F.col("__key").alias("__d_key"),
        F.col("__start_kind").alias("__d_kind"),
        F.col("__update").alias("__d_update"),
        *[F.col(f"c_{c}").alias(f"__d_{c}") for c in columns],
    )
    match = F.col(key).cast("string") == F.col("__d_key")
    if tenant is not None and entity.tenant is not None:
        match = match & (F.expr(entity.tenant) == F.lit(tenant))
    joined = target.join(patch, match, "left").filter(F.col("__d_kind").isNull())

    def column(name: str) -> Column:
        own = F.col(f"`{name}`")
        if name in columns and name != key:
            value = F.when(F.col(f"__d_{name}").isNotNull(), F.col(f"__d_{name}.v")).otherwise(own)
        elif name == "updated_at":
            value = F.when(F.col("__d_update").isNotNull(), as_ntz(as_of)).otherwise(own)
        else:
            value = own
        return value.cast(target.schema[name].dataType).alias(name)

    return joined.select(*[column(c) for c in target.columns])


def _as_table_rows(rows, target, entity, columns, as_of, tenant, run_id) -> DataFrame:
    """Created rows in the shape of the table."""

    def column(field: T.StructField) -> Column:
        name = field.name
        if name in columns:
            value = F.col(f"c_{name}.v")
        elif name == entity.id_field:
            value = ids.stable_uuid(F.lit(str(tenant)), F.lit(entity.name), F.lit(run_id), F.col("__born"))
        elif name == entity.tenant:
            value = F.lit(tenant)
        elif name in ("created_at", "updated_at"):
            value = as_ntz(as_of)
        else:
            value = F.lit(None)
        return value.cast(field.dataType).alias(name)

    return rows.select(*[column(f) for f in target.schema.fields])
