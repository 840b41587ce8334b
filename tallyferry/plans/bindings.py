"""The star-schema test tables declared as entities, so every operator runs over them unchanged.

Tenants are expressions over existing columns. `note` and `rebate` are order fields with nulls in them,
for the null rules of filters and sorts.
"""

from __future__ import annotations

from tallyferry.plans.registry import EntityDef, FieldDef, Registry, Relation


def _fields(**types: str) -> tuple[FieldDef, ...]:
    return tuple(FieldDef(name, kind, name.replace("_", " ").title()) for name, kind in types.items())


ORDER = EntityDef(
    name="order",
    label="Orders",
    fields=_fields(
        id="integer", amount="number", date="date", status="string", priority="string",
        customer_id="integer", note="string", rebate="number",
    ),
    relations=(
        Relation("customer", "customer", "customer_id",
                 _fields(id="integer", name="string", balance="number", segment="string", nation_id="integer")),
    ),
    tenant="o_custkey % 4",
    columns={
        "id": "o_orderkey", "amount": "o_totalprice", "date": "o_orderdate", "status": "o_orderstatus",
        "priority": "o_orderpriority", "customer_id": "o_custkey",
        "note": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END",
        "rebate": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END",
    },
    default_sort=(("date", "desc"),),
)

LINE = EntityDef(
    name="line",
    label="Order lines",
    fields=_fields(
        order_id="integer", line_no="integer", part_id="integer", supplier_id="integer", quantity="number",
        amount="number", discount="number", tax="number", flag="string", date="date",
    ),
    relations=(
        Relation("order", "order", "order_id", _fields(id="integer", status="string", priority="string", date="date")),
        Relation("part", "part", "part_id", _fields(id="integer", name="string", brand="string", type="string")),
        Relation("supplier", "supplier", "supplier_id", _fields(id="integer", name="string", balance="number")),
    ),
    tenant="l_suppkey % 4",
    columns={
        "order_id": "l_orderkey", "line_no": "l_linenumber", "part_id": "l_partkey", "supplier_id": "l_suppkey",
        "quantity": "l_quantity", "amount": "l_extendedprice", "discount": "l_discount", "tax": "l_tax",
        "flag": "l_returnflag", "date": "l_shipdate",
    },
    unique_sort=("order_id", "line_no", "part_id", "supplier_id", "amount", "date", "quantity"),
)

CUSTOMER = EntityDef(
    name="customer",
    label="Customers",
    fields=_fields(id="integer", name="string", balance="number", segment="string", nation_id="integer"),
    relations=(Relation("nation", "nation", "nation_id", _fields(id="integer", name="string")),),
    tenant="c_custkey % 4",
    columns={
        "id": "c_custkey", "name": "c_name", "balance": "c_acctbal", "segment": "c_mktsegment",
        "nation_id": "c_nationkey",
    },
)

SUPPLIER = EntityDef(
    name="supplier",
    label="Suppliers",
    fields=_fields(id="integer", name="string", balance="number", nation_id="integer"),
    relations=(Relation("nation", "nation", "nation_id", _fields(id="integer", name="string")),),
    tenant="s_suppkey % 4",
    columns={"id": "s_suppkey", "name": "s_name", "balance": "s_acctbal", "nation_id": "s_nationkey"},
)

PART = EntityDef(
    name="part",
    label="Parts",
    fields=_fields(id="integer", name="string", brand="string", type="string", size="integer", price="number"),
    tenant=None,
    columns={
        "id": "p_partkey", "name": "p_name", "brand": "p_brand", "type": "p_type", "size": "p_size",
        "price": "p_retailprice",
    },
)

NATION = EntityDef(
    name="nation",
    label="Nations",
    fields=_fields(id="integer", name="string", region_id="integer"),
    relations=(Relation("region", "region", "region_id", _fields(id="integer", name="string")),),
    tenant=None,
    columns={"id": "n_nationkey", "name": "n_name", "region_id": "n_regionkey"},
)

REGION = EntityDef(
    name="region",
    label="Regions",
    fields=_fields(id="integer", name="string"),
    tenant=None,
    columns={"id": "r_regionkey", "name": "r_name"},
)

EVENT = EntityDef(
    name="event",
    label="Events",
    fields=_fields(id="integer", ts="datetime", user_id="integer", type="string", value="number", props="string", k="string"),
    tenant="user_id % 4",
    columns={"id": "event_id", "type": "event_type", "k": "get_json_object(props, '$.k')"},
)

DOCUMENT = EntityDef(
    name="document",
    label="Documents",
    fields=_fields(id="integer", text="string", lang="string", source="string", n_chars="integer"),
    relations=(Relation("label", "label", "id", _fields(id="integer", quality="integer", toxic="integer")),),
    tenant=None,
    columns={"id": "doc_id"},
)

LABEL = EntityDef(
    name="label",
    label="Labels",
    fields=_fields(id="integer", quality="integer", toxic="integer"),
    tenant=None,
    columns={"id": "doc_id"},
)

PAGE = EntityDef(
    name="page",
    label="Pages",
    fields=_fields(id="integer", url="string", html="string"),
    tenant=None,
    columns={"id": "page_id"},
)

# Entity -> test table.
TABLES = {
    "order": "orders", "line": "lineitem", "customer": "customer", "supplier": "supplier", "part": "part",
    "nation": "nation", "region": "region", "event": "events", "document": "documents", "label": "labels",
    "page": "pages",
}


def star_registry() -> Registry:
    registry = Registry(
        (ORDER, LINE, CUSTOMER, SUPPLIER, PART, NATION, REGION, EVENT, DOCUMENT, LABEL, PAGE)
    )
    registry.check_names(TABLES)
    return registry
