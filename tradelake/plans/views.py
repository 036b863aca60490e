"""Denormalised views: functions from a mapping of tables to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tradelake.functions.json_text import scalar_text
from tradelake.functions.money import difference, product, to_number
from tradelake.functions.predicates import committed_purchase, live, reportable_sale
from tradelake.functions.times import month_start, whole_units

Tables = Mapping[str, DataFrame]

# Custom product fields shown in the stock view.
STOCK_FIELDS = {
    "collection": "PCF_COLLECTI",
    "unit_of_measure": "PCF_UOM",
    "size": "PCF_SIZE",
    "pattern": "PCF_PATTERN",
}


def with_parsed(df: DataFrame, schema: str, name: str) -> DataFrame:
    """Add the field of `raw_payload` that `schema` describes.

    The parse is a generator, so a filter on its values stays above it and a row
    is parsed once, however many conditions and columns use it.
    """
    return df.select("*", F.inline(F.array(F.from_json("raw_payload", f"{name} {schema}"))))


def unique_lookup(lookup: DataFrame, key: str = "id", label: str = "name") -> DataFrame:
    """One row per numeric id, so joining it can never multiply facts.

    Ids that are not numbers fall together under NULL and match nothing. The
    largest label wins, which unlike an arbitrary one is repeatable.
    """
    return lookup.groupBy(F.col(key).try_cast("bigint").alias(key)).agg(F.max(label).alias(label))


def sales_orders(tables: Tables) -> DataFrame:
    """Live sales orders that count as sales."""
    return tables["orders"].filter(
        (F.col("order_type_code") == "SO") & live() & reportable_sale()
    )


def sales_flat(tables: Tables) -> DataFrame:
    """One row per line of a reportable sales order, with cost and margin."""
    channels = unique_lookup(tables["channels"]).select(
        F.col("id").alias("channel_id"), F.col("name").alias("channel_name")
    )
    # The lookup meets the orders, not the far more numerous lines.
    orders = (
        sales_orders(tables)
        .select(
            "order_id", "reference", "placed_on", "created_on", "order_status_name",
            "order_payment_status", "shipping_status_code", "customer_contact_id",
            "customer_company_name", "customer_email", "delivery_state",
            "delivery_country_iso", "channel_id", "currency_code",
            F.col("total").alias("order_total"),
        )
        .join(channels, "channel_id", "left")
    )
    cost = product(F.col("quantity"), F.col("item_cost"))
    lines = tables["order_rows"].select(
        "order_id", "order_row_id", "product_id", "product_sku", "product_name", "quantity",
        F.col("product_price").alias("unit_price"), F.col("item_cost").alias("unit_cost"),
        "row_net", "row_tax", "nominal_code", cost.alias("row_cost"),
        difference(F.col("row_net"), cost).alias("row_margin"),
    )
    return orders.join(lines, "order_id")


def stock_products(tables: Tables) -> DataFrame:
    """Live products with their custom fields."""
    fields = ", ".join(f"{f}: VARIANT" for f in STOCK_FIELDS.values())
    live_products = (
        tables["products"]
        .filter((F.col("status") == "LIVE") & live())
        .select("product_id", "sku", "name", "status", "brand_id", "raw_payload")
    )
    return with_parsed(live_products, f"STRUCT<{fields}>", "customFields").select(
        "product_id", "sku", "name", "status", "brand_id",
        *[scalar_text(F.col(f"customFields.{f}")).alias(n) for n, f in STOCK_FIELDS.items()],
    )


def inventory_position(tables: Tables) -> DataFrame:
    """Live products by warehouse, with names and custom fields."""
    products = stock_products(tables)
    brands = tables["brands"].select("brand_id", "brand_name")
    warehouses = tables["warehouses"].select(
        F.col("id").alias("warehouse_id"), F.col("name").alias("warehouse_name")
    )
    stock = tables["product_availability"].select(
        "product_id", "warehouse_id", "on_hand", "allocated", "in_stock", "on_order",
        F.col("when_upserted").alias("stock_as_of"),
    )
    return (
        products.join(brands, "brand_id", "left")
        .join(stock, "product_id", "left")
        .join(warehouses, "warehouse_id", "left")
        .select(
            "product_id", "sku", "name", "status", "brand_name", *STOCK_FIELDS, "warehouse_id",
            "warehouse_name", "on_hand", "allocated", "in_stock", "on_order", "stock_as_of",
        )
    )


def po_pipeline(tables: Tables) -> DataFrame:
    """One row per line of a committed purchase order, with its supplier."""
    warehouses = tables["warehouses"].select(
        F.col("id").alias("warehouse_id"), F.col("name").alias("warehouse_name")
    )
    purchases = (
        tables["orders"]
        .filter((F.col("order_type_code") == "PO") & live() & committed_purchase())
        .select(
            "order_id", "reference", "placed_on", "created_on", "order_status_name",
            "stock_status_code", "raw_payload", "warehouse_id", "currency_code",
            F.col("total").alias("order_total"),
        )
    )
    shape = "STRUCT<supplier: STRUCT<companyName: VARIANT, contactId: VARIANT>>"
    orders = (
        with_parsed(purchases, shape, "parties")
        .withColumn("supplier_name", scalar_text(F.col("parties.supplier.companyName")))
        .withColumn("supplier_contact_id", scalar_text(F.col("parties.supplier.contactId")))
        .drop("parties", "raw_payload")
        .join(warehouses, "warehouse_id", "left")
    )
    lines = tables["order_rows"].select(
        "order_id", "order_row_id", "product_id", "product_sku", "product_name", "quantity",
        F.col("item_cost").alias("unit_cost"), "row_net",
    )
    return orders.join(lines, "order_id")


def customer_summary(tables: Tables, as_of: Column | None = None) -> DataFrame:
    """Lifetime figures per live customer, who need not have ordered.

    Orders are summed up per customer before they meet the contacts, which are
    keyed by contact_id; a customer with very many orders costs one partial
    aggregate per task.
    """
    now = F.current_timestamp() if as_of is None else as_of
    stats = (
        sales_orders(tables)
        .groupBy(F.col("customer_contact_id").alias("contact_id"))
        .agg(
            F.count_distinct("order_id").alias("order_count"),
            F.sum("total").alias("lifetime_value"),
            F.round(F.avg(F.col("total").cast("decimal(38,9)")), 9).alias("avg_order_value"),
            F.min("placed_on").alias("first_order_on"),
            F.max("placed_on").alias("last_order_on"),
        )
    )
    customers = tables["contacts"].filter(live()).select(
        "contact_id", "first_name", "last_name", "email", "organisation_name", "company_id",
        F.col("created_on").alias("customer_since"),
    )
    return customers.join(stats, "contact_id", "left").select(
        *customers.columns,
        F.coalesce("order_count", F.lit(0)).alias("order_count"),
        "lifetime_value", "avg_order_value", "first_order_on", "last_order_on",
        whole_units("DAY", F.col("last_order_on"), now).alias("days_since_last_order"),
    )


def monthly_financials(tables: Tables) -> DataFrame:
    """Debit and credit per month and account.

    Ledger lines are summed before the account names are joined. The second
    aggregate is over that small result and keeps the totals right even if a
    code has several names.
    """
    sums = (
        tables["journal_rows"]
        .groupBy(month_start(F.col("journal_date")).alias("month"), "nominal_code")
        .agg(
            F.sum(to_number(F.col("journal_debit"))).alias("debit"),
            F.sum(to_number(F.col("journal_credit"))).alias("credit"),
            F.count(F.lit(1)).alias("lines"),
        )
    )
    codes = tables["nominal_codes"].select(
        F.col("code").alias("nominal_code"), F.col("name").alias("nominal_name"),
        F.col("type").alias("nominal_type"),
    )
    return (
        sums.join(codes, "nominal_code", "left")
        .groupBy("month", "nominal_code", "nominal_name", "nominal_type")
        .agg(
            F.sum("debit").alias("total_debit"),
            F.sum("credit").alias("total_credit"),
            F.sum("lines").alias("line_count"),
        )
        .withColumn("net_credit", difference(F.col("total_credit"), F.col("total_debit")))
    )


def sales_unified(tables: Tables) -> DataFrame:
    """Sales lines of both eras in one shape, tagged by `source`."""
    current = sales_flat(tables).select(
        F.lit("current").alias("source"),
        F.col("order_id").cast("string").alias("order_ref"),
        F.to_date("placed_on").alias("order_date"),
        F.col("customer_contact_id").alias("customer_id"),
        "customer_email",
        F.col("customer_company_name").alias("customer_company"),
        F.col("delivery_state").alias("ship_state"),
        F.col("channel_name").alias("channel"),
        "product_id",
        F.col("product_sku").alias("sku"),
        "product_name",
        "quantity",
        F.lit(None).cast("string").alias("unit_of_measure"),
        F.col("row_net").alias("line_net"),
    )
    legacy = tables["legacy_sales"].select(
        F.lit("legacy").alias("source"),
        F.col("source_order_id").alias("order_ref"),
        *[c for c in current.columns if c not in ("source", "order_ref")],
    )
    return current.unionByName(legacy)


def product_variations(tables: Tables) -> DataFrame:
    """One row per product and option value; products without any drop out.

    Ids are cast strictly: a non-numeric id is an error, not a NULL.
    """
    entries = F.from_json(
        "raw_payload",
        "variations ARRAY<STRUCT<optionId: VARIANT, optionName: VARIANT, "
        "optionValueId: VARIANT, optionValue: VARIANT>>",
    ).getField("variations")
    return (
        tables["products"]
        .filter(live())
        .select(
            "product_id", "sku", F.col("name").alias("product_name"), "status",
            F.explode(entries).alias("v"),
        )
        .select(
            "product_id", "sku", "product_name", "status",
            scalar_text(F.col("v.optionId")).cast("bigint").alias("option_id"),
            scalar_text(F.col("v.optionName")).alias("option_name"),
            scalar_text(F.col("v.optionValueId")).cast("bigint").alias("option_value_id"),
            scalar_text(F.col("v.optionValue")).alias("option_value"),
        )
    )


VIEWS: dict[str, Callable[[Tables], DataFrame]] = {
    "sales_flat": sales_flat,
    "inventory_position": inventory_position,
    "po_pipeline": po_pipeline,
    "customer_summary": customer_summary,
    "monthly_financials": monthly_financials,
    "sales_unified": sales_unified,
    "product_variations": product_variations,
}


def register_views(spark: SparkSession, tables: Tables) -> list[str]:
    """Create or replace every view by name, for SQL users."""
    for name, view in VIEWS.items():
        view(tables).createOrReplaceTempView(name)
    return list(VIEWS)


def era_overlap(tables: Tables) -> DataFrame:
    """The eras' date ranges and whether they overlap (they must not)."""
    current = sales_orders(tables).agg(F.min(F.to_date("placed_on")).alias("current_from"))
    legacy = tables["legacy_sales"].agg(F.max("order_date").alias("legacy_to"))
    both = current.unionByName(legacy, allowMissingColumns=True)
    return both.agg(
        F.max("current_from").alias("current_from"), F.max("legacy_to").alias("legacy_to")
    ).withColumn(
        "overlaps", F.coalesce(F.col("legacy_to") >= F.col("current_from"), F.lit(False))
    )


def assert_eras_disjoint(tables: Tables) -> None:
    row = era_overlap(tables).first()
    if row["overlaps"]:
        raise ValueError(
            f"legacy sales reach {row['legacy_to']}, current sales start {row['current_from']}"
        )


def at(text: str | datetime) -> Column:
    """A point in time as a column, for `as_of` parameters."""
    return F.lit(text).cast("timestamp")
