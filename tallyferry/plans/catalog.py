"""The four standard business entities as data.

Fixed values throughout: names, types, labels, required fields, defaults and links must stay as they
are for exports and imports to keep their meaning.
"""

from __future__ import annotations

from pyspark.sql import types as T

from tallyferry.functions.rules import AMOUNT_IS_POSITIVE, DUE_NOT_BEFORE_DATE
from tallyferry.plans.registry import EntityDef, FieldDef, ForeignKey, MergeColumn, Registry, Relation

_RATE = T.DecimalType(10, 4)
_ID = FieldDef("id", "uuid", "ID")
_EXTERNAL = FieldDef("external_id", "string", "External ID")
_STAMPS = (FieldDef("created_at", "datetime", "Created At"), FieldDef("updated_at", "datetime", "Updated At"))


def _vendor(foreign_key: str) -> Relation:
    return Relation(
        "vendor",
        "vendor",
        foreign_key,
        (
            FieldDef("id", "uuid", "Vendor ID"),
            FieldDef("name", "string", "Vendor Name"),
            FieldDef("email", "string", "Vendor Email"),
        ),
    )


_PROJECT = Relation(
    "project",
    "project",
    "project_id",
    (
        FieldDef("id", "uuid", "Project ID"),
        FieldDef("code", "string", "Project Code"),
        FieldDef("name", "string", "Project Name"),
    ),
)

BILL = EntityDef(
    name="bill",
    label="Bills",
    description="Amounts owed to vendors",
    fields=(
        _ID,
        _EXTERNAL,
        FieldDef("amount", "number", "Amount", required=True),
        FieldDef("date", "date", "Date", required=True),
        FieldDef("due_date", "date", "Due Date"),
        FieldDef("status", "string", "Status"),
        FieldDef("description", "string", "Description"),
        FieldDef("currency", "string", "Currency"),
        FieldDef("vendor_id", "uuid", "Vendor ID"),
        FieldDef("project_id", "uuid", "Project ID"),
        *_STAMPS,
    ),
    relations=(_vendor("vendor_id"), _PROJECT),
    required=("amount", "date"),
    date_fields=frozenset({"date", "due_date", "paid_on_date"}),
    decimal_fields=frozenset({"amount"}),
    rules=(AMOUNT_IS_POSITIVE, DUE_NOT_BEFORE_DATE),
    default_sort=(("date", "desc"),),
    merge_columns=(
        MergeColumn("external_id"),
        MergeColumn("bill_number"),
        MergeColumn("amount", type="number", default="0"),
        MergeColumn("date", type="date", unparsed_is_now=True),
        MergeColumn("due_date", type="date"),
        MergeColumn("paid_on_date", type="date"),
        MergeColumn("description"),
        MergeColumn("currency", default="USD"),
        MergeColumn("status", default="pending"),
        MergeColumn("line_items"),
    ),
    foreign_keys=(
        ForeignKey("vendor_id", "vendor", nested="vendor", external="vendor_external_id"),
        ForeignKey("project_id", "project", nested="project", external="project_external_id"),
    ),
)

INVOICE = EntityDef(
    name="invoice",
    label="Invoices",
    description="Amounts billed to customers",
    fields=(
        _ID,
        _EXTERNAL,
        FieldDef("amount", "number", "Amount", required=True),
        FieldDef("date", "date", "Date", required=True),
        FieldDef("due_date", "date", "Due Date"),
        FieldDef("status", "string", "Status"),
        FieldDef("description", "string", "Description"),
        FieldDef("currency", "string", "Currency"),
        FieldDef("vendor_id", "uuid", "Vendor ID"),
        FieldDef("customer_id", "uuid", "Customer ID"),
        FieldDef("project_id", "uuid", "Project ID"),
        *_STAMPS,
    ),
    relations=(_vendor("contact_id"), _PROJECT),
    required=("amount", "date"),
    date_fields=frozenset({"issue_date", "due_date", "paid_on_date"}),
    decimal_fields=frozenset({"total_amount", "sub_total", "total_tax_amount", "balance", "exchange_rate"}),
    default_sort=(("date", "desc"),),
    merge_columns=(
        MergeColumn("external_id"),
        MergeColumn("invoice_number"),
        MergeColumn("issue_date", ("issue_date", "date"), "date"),
        MergeColumn("due_date", type="date"),
        MergeColumn("paid_on_date", type="date"),
        MergeColumn("memo", ("memo", "description"), update_sources=("memo",)),
        MergeColumn("currency", default="USD"),
        MergeColumn("exchange_rate", type="number", data_type=_RATE),
        MergeColumn("sub_total", type="number"),
        MergeColumn("total_tax_amount", type="number"),
        MergeColumn("total_amount", ("total_amount", "amount"), "number", default="0"),
        MergeColumn("balance", type="number"),
        MergeColumn("status", default="DRAFT"),
        MergeColumn("line_items"),
        MergeColumn("tracking_categories"),
    ),
    foreign_keys=(ForeignKey("contact_id", "vendor", nested="vendor"),),
)

VENDOR = EntityDef(
    name="vendor",
    label="Vendors",
    description="Suppliers and service providers",
    fields=(
        _ID,
        _EXTERNAL,
        FieldDef("name", "string", "Name", required=True),
        FieldDef("email", "string", "Email"),
        FieldDef("phone", "string", "Phone"),
        FieldDef("address", "string", "Address"),
        *_STAMPS,
    ),
    relations=(_PROJECT,),
    required=("name",),
    overlay="replace",
    merge_columns=(
        MergeColumn("external_id"),
        MergeColumn("name", default=""),
        MergeColumn("email_address", ("email_address", "email")),
        MergeColumn("phone"),
        MergeColumn("tax_number"),
        MergeColumn("is_supplier", type="boolean", default=True),
        MergeColumn("is_customer", type="boolean", default=False),
        MergeColumn("status", default="ACTIVE"),
        MergeColumn("currency", default="USD"),
        MergeColumn("address"),
        MergeColumn("phone_numbers"),
    ),
)

PROJECT = EntityDef(
    name="project",
    label="Projects",
    description="Projects that work and costs are booked on",
    fields=(
        _ID,
        _EXTERNAL,
        FieldDef("code", "string", "Code", required=True),
        FieldDef("name", "string", "Name", required=True),
        FieldDef("description", "string", "Description"),
        FieldDef("status", "string", "Status"),
        *_STAMPS,
    ),
    required=("code", "name"),
    date_fields=frozenset({"start_date", "end_date"}),
    decimal_fields=frozenset({"budget"}),
    merge_columns=(
        MergeColumn("external_id"),
        MergeColumn("code"),
        MergeColumn("name", default=""),
        MergeColumn("description"),
        MergeColumn("status", default="active"),
        MergeColumn("start_date", type="date"),
        MergeColumn("end_date", type="date"),
        MergeColumn("budget", type="number"),
        MergeColumn("currency", default="USD"),
    ),
)

ENTITY_NAMES = ("bill", "invoice", "vendor", "project")


def standard_registry() -> Registry:
    registry = Registry((BILL, INVOICE, VENDOR, PROJECT))
    registry.check_names(ENTITY_NAMES)
    return registry
