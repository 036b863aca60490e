"""Table schemas, keys and the list of synced resources."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tradelake.functions.times import instant


_TYPES = {
    "BIGINT": T.LongType(),
    "STRING": T.StringType(),
    "BOOLEAN": T.BooleanType(),
    "TIMESTAMP": T.TimestampType(),
    "DATE": T.DateType(),
    "DECIMAL(38,9)": T.DecimalType(38, 9),
}


def table_schema(ddl: str) -> T.StructType:
    """A schema from "name TYPE [NOT NULL], ..."; works before a session exists."""
    fields = [re.split(r"\s+", part.strip(), maxsplit=2) for part in re.split(r",\s+", ddl.strip())]
    return T.StructType([T.StructField(name, _TYPES[kind], not rest) for name, kind, *rest in fields])


@dataclass(frozen=True)
class TableSpec:
    """How one keyed table is stored.

    `cluster_by` is the column writes look rows up by: the key itself, or the
    parent's key for child tables. `buckets` sets how many directories the
    table is split into, so a small write touches few of them; a stored table
    keeps the count it was written with. Tables whose rows the key does not
    tell apart are not `unique`: they can be loaded whole or replaced by
    parent, not upserted.
    """

    name: str
    schema: T.StructType
    key: str
    cluster_by: str = ""
    order_col: str = "when_upserted"
    buckets: int = 8
    unique: bool = True

    @property
    def cluster_column(self) -> str:
        return self.cluster_by or self.key


# The columns of the tables, their order and types.

ORDERS = table_schema("""
    order_id BIGINT NOT NULL,
    parent_order_id BIGINT,
    order_type_code STRING,
    reference STRING,
    order_status_id BIGINT,
    order_status_name STRING,
    order_payment_status STRING,
    stock_status_code STRING,
    allocation_status_code STRING,
    shipping_status_code STRING,
    placed_on TIMESTAMP,
    created_on TIMESTAMP,
    updated_on TIMESTAMP,
    closed_on TIMESTAMP,
    customer_contact_id BIGINT,
    customer_company_name STRING,
    customer_email STRING,
    delivery_state STRING,
    delivery_postal_code STRING,
    delivery_country_iso STRING,
    warehouse_id BIGINT,
    channel_id BIGINT,
    lead_source_id BIGINT,
    staff_owner_contact_id BIGINT,
    currency_code STRING,
    exchange_rate DECIMAL(38,9),
    total_net DECIMAL(38,9),
    total_tax DECIMAL(38,9),
    total DECIMAL(38,9),
    base_total_net DECIMAL(38,9),
    base_total DECIMAL(38,9),
    invoice_reference STRING,
    price_list_id BIGINT,
    historical_order BOOLEAN,
    is_deleted BOOLEAN,
    deleted_at TIMESTAMP,
    raw_payload STRING,
    when_upserted TIMESTAMP NOT NULL
""")

ORDER_ROWS = table_schema("""
    order_row_id BIGINT NOT NULL,
    order_id BIGINT NOT NULL,
    row_sequence BIGINT,
    product_id BIGINT,
    product_name STRING,
    product_sku STRING,
    quantity DECIMAL(38,9),
    item_cost DECIMAL(38,9),
    product_price DECIMAL(38,9),
    discount_percentage DECIMAL(38,9),
    row_net DECIMAL(38,9),
    row_tax DECIMAL(38,9),
    tax_rate DECIMAL(38,9),
    tax_code STRING,
    nominal_code STRING,
    bundle_parent BOOLEAN,
    bundle_child BOOLEAN,
    parent_order_row_id BIGINT,
    product_options STRING,
    order_updated_on TIMESTAMP,
    when_upserted TIMESTAMP NOT NULL
""")

PRODUCTS = table_schema("""
    product_id BIGINT NOT NULL,
    sku STRING,
    barcode STRING,
    name STRING,
    status STRING,
    brand_id BIGINT,
    product_type_id BIGINT,
    product_group_id BIGINT,
    stock_tracked BOOLEAN,
    weight DECIMAL(38,9),
    is_bundle BOOLEAN,
    nominal_code_sales STRING,
    nominal_code_purchases STRING,
    nominal_code_stock STRING,
    created_on TIMESTAMP,
    updated_on TIMESTAMP,
    is_deleted BOOLEAN,
    deleted_at TIMESTAMP,
    raw_payload STRING,
    when_upserted TIMESTAMP NOT NULL
""")

CONTACTS = table_schema("""
    contact_id BIGINT NOT NULL,
    first_name STRING,
    last_name STRING,
    email STRING,
    telephone STRING,
    company_id BIGINT,
    organisation_name STRING,
    is_supplier BOOLEAN,
    is_staff BOOLEAN,
    price_list_id BIGINT,
    credit_term_days BIGINT,
    currency_id BIGINT,
    contact_tags STRING,
    created_on TIMESTAMP,
    updated_on TIMESTAMP,
    last_contacted_on TIMESTAMP,
    is_deleted BOOLEAN,
    deleted_at TIMESTAMP,
    raw_payload STRING,
    when_upserted TIMESTAMP NOT NULL
""")

SYNC_STATE = table_schema("""
    resource STRING NOT NULL,
    watermark_updated_on TIMESTAMP,
    watermark_id BIGINT,
    last_run_at TIMESTAMP,
    last_run_kind STRING,
    last_run_rows BIGINT
""")

PRODUCT_PRICES = table_schema("""
    product_id BIGINT NOT NULL,
    price_list_id BIGINT NOT NULL,
    price DECIMAL(38,9),
    quantity_prices STRING,
    when_upserted TIMESTAMP NOT NULL
""")

PRODUCT_SUPPLIERS = table_schema("""
    product_id BIGINT NOT NULL,
    supplier_contact_id BIGINT NOT NULL,
    is_primary BOOLEAN,
    when_upserted TIMESTAMP NOT NULL
""")

PRODUCT_AVAILABILITY = table_schema("""
    product_id BIGINT NOT NULL,
    warehouse_id BIGINT,
    on_hand DECIMAL(38,9),
    allocated DECIMAL(38,9),
    in_stock DECIMAL(38,9),
    on_order DECIMAL(38,9),
    when_upserted TIMESTAMP NOT NULL
""")

REFERENCE_ITEMS = table_schema("""
    id STRING,
    name STRING,
    raw_payload STRING,
    when_upserted TIMESTAMP NOT NULL
""")

LEGACY_SALES = table_schema("""
    source_order_id STRING NOT NULL,
    source_line_id STRING,
    line_uid STRING NOT NULL,
    order_date DATE NOT NULL,
    order_status STRING,
    customer_id BIGINT,
    customer_email STRING,
    customer_company STRING,
    ship_state STRING,
    channel STRING,
    product_id BIGINT,
    sku STRING,
    product_name STRING,
    unit_of_measure STRING,
    quantity DECIMAL(38,9),
    line_net DECIMAL(38,9),
    raw_payload STRING,
    when_upserted TIMESTAMP NOT NULL
""")

QUESTION_LOG = table_schema("""
    called_at TIMESTAMP NOT NULL,
    tool STRING NOT NULL,
    arguments STRING,
    ok BOOLEAN,
    detail STRING,
    user_email STRING
""")

TABLES = {
    spec.name: spec
    for spec in (
        TableSpec("orders", ORDERS, "order_id"),
        TableSpec("order_rows", ORDER_ROWS, "order_row_id", cluster_by="order_id"),
        TableSpec("products", PRODUCTS, "product_id"),
        TableSpec("contacts", CONTACTS, "contact_id"),
        TableSpec("sync_state", SYNC_STATE, "resource", order_col="last_run_at", buckets=1),
        TableSpec("product_prices", PRODUCT_PRICES, "product_id", unique=False),
        TableSpec("product_suppliers", PRODUCT_SUPPLIERS, "product_id", unique=False),
        TableSpec("product_availability", PRODUCT_AVAILABILITY, "product_id", unique=False),
    )
}


class Resource(NamedTuple):
    name: str
    kind: str  # detail | search | reference
    key: str | None
    mode: str  # updated | id | full
    cursor: str | None
    tier: str  # hot | warm | cold


# The resources a deployment syncs, with the key of each, how it
# advances and how fresh it must be.
RESOURCES = (
    Resource("orders", "detail", "orderId", "updated", "updatedOn", "hot"),
    Resource("products", "detail", "productId", "updated", "updatedOn", "cold"),
    Resource("contacts", "detail", "contactId", "updated", "updatedOn", "warm"),
    Resource("journal_rows", "search", "journalRowId", "id", "journalRowId", "warm"),
    Resource("customer_payments", "search", "paymentId", "id", "paymentId", "warm"),
    Resource("supplier_payments", "search", "paymentId", "id", "paymentId", "warm"),
    Resource("goods_movements", "search", "goodsMovementId", "updated", "updatedOn", "hot"),
    Resource("goods_out_notes", "search", "goodsOutNoteId", "updated", "shippedOn", "warm"),
    Resource("companies", "search", "companyId", "full", None, "warm"),
    Resource("brands", "search", "brandId", "updated", "updatedOn", "warm"),
    Resource("collections", "search", "collectionId", "updated", "updatedOn", "warm"),
    Resource("product_types", "search", "id", "updated", "updatedOn", "warm"),
    Resource("seasons", "search", "id", "updated", "updatedOn", "warm"),
    Resource("contact_groups", "search", "contactGroupId", "full", None, "cold"),
    Resource("nominal_codes", "search", "code", "full", None, "cold"),
    Resource("currencies", "search", "id", "full", None, "cold"),
    Resource("payment_methods", "search", "id", "full", None, "cold"),
    Resource("warehouses", "search", "id", "full", None, "cold"),
    Resource("shipping_methods", "search", "id", "full", None, "cold"),
    Resource("categories", "search", "id", "updated", "updatedOn", "warm"),
    Resource("warehouse_locations", "search", "id", "full", None, "cold"),
    Resource("product_options", "search", "id", "updated", "updatedOn", "warm"),
    Resource("product_option_values", "search", "optionValueId", "updated", "updatedOn", "warm"),
    Resource("contact_group_members", "search", "contactGroupId", "full", None, "cold"),
    Resource("order_statuses", "reference", "id", "full", None, "cold"),
    Resource("order_types", "reference", "id", "full", None, "cold"),
    Resource("order_stock_statuses", "reference", "id", "full", None, "cold"),
    Resource("order_shipping_statuses", "reference", "id", "full", None, "cold"),
    Resource("tax_codes", "reference", "id", "full", None, "cold"),
    Resource("accounting_periods", "reference", "id", "full", None, "cold"),
    Resource("lead_sources", "reference", "id", "full", None, "cold"),
    Resource("contact_tags", "reference", "id", "full", None, "cold"),
    Resource("price_lists", "reference", "id", "full", None, "cold"),
    Resource("channel_brands", "reference", "id", "full", None, "cold"),
    Resource("channels", "reference", "id", "full", None, "cold"),
)

# Minutes a resource of each tier may lag before it is stale.
TIER_BUDGET_MINUTES = {"hot": 30, "warm": 120, "cold": 3000}


def resource_frame(spark: SparkSession) -> DataFrame:
    """The registry as a frame, with the staleness budget of each resource."""
    rows = [(*r, TIER_BUDGET_MINUTES[r.tier]) for r in RESOURCES]
    return spark.createDataFrame(
        rows,
        "resource STRING, kind STRING, key STRING, mode STRING, cursor STRING, tier STRING, "
        "budget BIGINT",
    )


def typed(df: DataFrame, field: T.StructField) -> Column:
    """A column of `df` with the type of `field`; NULL if it is absent."""
    have = {f.name: f.dataType for f in df.schema.fields}
    if field.name not in have:
        value = F.lit(None).cast(field.dataType)
    elif field.dataType == T.TimestampType() and have[field.name] == T.StringType():
        value = instant(F.col(field.name))
    else:
        value = F.col(field.name).cast(field.dataType)
    return value.alias(field.name)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Order and type columns as `schema` says; absent ones become NULL.

    New columns are only ever added, so a frame made for an older schema still
    fits. Values cast strictly: text that is not of the type raises.
    """
    return df.select(*[typed(df, field) for field in schema.fields])

TABLES.update({r.name: TableSpec(r.name, REFERENCE_ITEMS, "id") for r in RESOURCES if r.kind == "reference"})
