"""Payloads to table rows.

A missing object inside a payload reads as NULL, like a missing value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tradelake.functions.json_text import scalar_text
from tradelake.functions.predicates import live
from tradelake.schemas import (
    CONTACTS, ORDER_ROWS, ORDERS, PRODUCT_AVAILABILITY, PRODUCT_PRICES, PRODUCT_SUPPLIERS,
    PRODUCTS, conform,
)
from tradelake.sources import payloads as P


def _filled(text: Column) -> Column:
    """Text, with empty as NULL."""
    return F.nullif(text, F.lit(""))


def _nonzero(text: Column) -> Column:
    """An id for which 0 and empty mean none."""
    return F.nullif(_filled(text).cast("bigint"), F.lit(0).cast("bigint"))


def _payload_text(raw: DataFrame) -> Column:
    """The payload in full: its own text, or a VARIANT's JSON text."""
    return F.col("raw_payload") if "raw_payload" in raw.columns else F.to_json("p")


def _parsed(raw: DataFrame) -> DataFrame:
    """Parsed payloads, beside their own text where there is one."""
    return P.parse(raw, *[c for c in ("raw_payload",) if c in raw.columns])


def _named(columns: dict[str, str | Column]) -> list[Column]:
    return [
        (F.col(source) if isinstance(source, str) else source).alias(name)
        for name, source in columns.items()
    ]


# Objects of each payload, by the path of a member.
ORDER_OBJECTS = (
    "id", "orderStatus.orderStatusId", "currency.orderCurrencyCode", "totalValue.net", "assignment.current",
    "assignment.current.channelId", "parties.customer", "parties.customer.contactId", "parties.delivery.addressLine4",
)


def order_headers(raw: DataFrame, now: Column) -> DataFrame:
    """Payloads to rows of `orders`."""
    m = P.Members()
    columns = {
        "order_id": m.text("id"),
        "parent_order_id": _nonzero(m.text("parentOrderId")),
        "order_type_code": m.text("orderTypeCode"),
        "reference": m.text("reference"),
        "order_status_id": m.text("orderStatus.orderStatusId"),
        "order_status_name": m.text("orderStatus.name"),
        "order_payment_status": m.text("orderPaymentStatus"),
        "stock_status_code": m.text("stockStatusCode"),
        "allocation_status_code": m.text("allocationStatusCode"),
        "shipping_status_code": m.text("shippingStatusCode"),
        "placed_on": m.text("placedOn"),
        "created_on": m.text("createdOn"),
        "updated_on": m.text("updatedOn"),
        "closed_on": m.text("closedOn"),
        "customer_contact_id": m.text("parties.customer.contactId"),
        "customer_company_name": m.text("parties.customer.companyName"),
        "customer_email": m.text("parties.customer.email"),
        "delivery_state": m.text("parties.delivery.addressLine4"),
        "delivery_postal_code": m.text("parties.delivery.postalCode"),
        "delivery_country_iso": m.text("parties.delivery.countryIsoCode"),
        "warehouse_id": m.text("warehouseId"),
        "channel_id": m.text("assignment.current.channelId"),
        "lead_source_id": m.text("assignment.current.leadSourceId"),
        "staff_owner_contact_id": m.text("assignment.current.staffOwnerContactId"),
        "currency_code": m.text("currency.orderCurrencyCode"),
        "exchange_rate": _filled(m.text("currency.exchangeRate")),
        "total_net": _filled(m.text("totalValue.net")),
        "total_tax": _filled(m.text("totalValue.taxAmount")),
        "total": _filled(m.text("totalValue.total")),
        "base_total_net": _filled(m.text("totalValue.baseNet")),
        "base_total": _filled(m.text("totalValue.baseTotal")),
        "invoice_reference": m.text("invoices[0].invoiceReference"),
        "price_list_id": m.text("priceListId"),
        "historical_order": m.text("historicalOrder"),
        "is_deleted": F.lit(False),
        "raw_payload": _payload_text(raw),
        "when_upserted": now,
    }
    df = m.over(_parsed(raw), ORDER_OBJECTS, ("invoices",)).select(*_named(columns))
    return conform(df, ORDERS)


LINE_OBJECTS = (
    "productId", "quantity.magnitude", "itemCost.value", "productPrice.value", "rowValue.rowNet",
    "rowValue.rowNet.value", "rowValue.rowTax.value", "composition.bundleParent",
)


def order_lines(raw: DataFrame, now: Column) -> DataFrame:
    """Payloads to rows of `order_rows`; orders without lines give none."""
    order, m = P.Members(), P.Members("line")
    heads = [order.text("id").alias("id"), order.text("updatedOn").alias("updatedOn")]
    rows = F.explode(order.members("orderRows")).alias("row_key", "line")
    lines = order.over(P.parse(raw), ("id",)).select(*heads, rows)
    columns = {
        "order_row_id": "row_key",
        "order_id": "id",
        "row_sequence": _filled(m.text("orderRowSequence")),
        "product_id": m.text("productId"),
        "product_name": m.text("productName"),
        "product_sku": m.text("productSku"),
        "quantity": _filled(m.text("quantity.magnitude")),
        "item_cost": _filled(m.text("itemCost.value")),
        "product_price": _filled(m.text("productPrice.value")),
        "discount_percentage": _filled(m.text("discountPercentage")),
        "row_net": _filled(m.text("rowValue.rowNet.value")),
        "row_tax": _filled(m.text("rowValue.rowTax.value")),
        "tax_rate": _filled(m.text("rowValue.taxRate")),
        "tax_code": m.text("rowValue.taxCode"),
        "nominal_code": m.text("nominalCode"),
        "bundle_parent": m.text("composition.bundleParent"),
        "bundle_child": m.text("composition.bundleChild"),
        "parent_order_row_id": _nonzero(m.text("composition.parentOrderRowId")),
        "product_options": P.present("productOptions", "line"),
        "order_updated_on": "updatedOn",
        "when_upserted": now,
    }
    df = m.over(lines, LINE_OBJECTS).select(*_named(columns))
    return conform(df, ORDER_ROWS)


def product_rows(raw: DataFrame, now: Column) -> DataFrame:
    objects = ("id", "identity.sku", "stock.stockTracked", "stock.weight.magnitude", "composition.bundle")
    m = P.Members()
    columns = {
        "product_id": m.text("id"),
        "sku": m.text("identity.sku"),
        "barcode": m.text("identity.barcode"),
        "name": m.text("salesChannels[0].productName"),
        "status": m.text("status"),
        "brand_id": m.text("brandId"),
        "product_type_id": m.text("productTypeId"),
        "product_group_id": m.text("productGroupId"),
        "stock_tracked": m.text("stock.stockTracked"),
        "weight": _filled(m.text("stock.weight.magnitude")),
        "is_bundle": m.text("composition.bundle"),
        "nominal_code_sales": m.text("nominalCodeSales"),
        "nominal_code_purchases": m.text("nominalCodePurchases"),
        "nominal_code_stock": m.text("nominalCodeStock"),
        "created_on": m.text("createdOn"),
        "updated_on": m.text("updatedOn"),
        "is_deleted": F.lit(False),
        "raw_payload": _payload_text(raw),
        "when_upserted": now,
    }
    df = m.over(_parsed(raw), objects, ("salesChannels",)).select(*_named(columns))
    return conform(df, PRODUCTS)


CONTACT_OBJECTS = (
    "contactId", "communication.emails", "communication.emails.PRI", "communication.emails.PRI.email",
    "communication.telephones.PRI", "relationshipToAccount.isSupplier", "financialDetails.creditTermDays",
    "organisation.name",
)


def contact_rows(raw: DataFrame, now: Column) -> DataFrame:
    m = P.Members()
    columns = {
        "contact_id": m.text("contactId"),
        "first_name": m.text("firstName"),
        "last_name": m.text("lastName"),
        "email": m.text("communication.emails.PRI.email"),
        "telephone": m.text("communication.telephones.PRI"),
        "company_id": m.text("companyId"),
        "organisation_name": m.text("organisation.name"),
        "is_supplier": m.text("relationshipToAccount.isSupplier"),
        "is_staff": m.text("relationshipToAccount.isStaff"),
        "price_list_id": m.text("financialDetails.priceListId"),
        "credit_term_days": m.text("financialDetails.creditTermDays"),
        "currency_id": m.text("financialDetails.currencyId"),
        "contact_tags": m.text("contactTags"),
        "created_on": m.text("createdOn"),
        "updated_on": m.text("updatedOn"),
        "last_contacted_on": m.text("lastContactedOn"),
        "is_deleted": F.lit(False),
        "raw_payload": _payload_text(raw),
        "when_upserted": now,
    }
    df = m.over(_parsed(raw), CONTACT_OBJECTS).select(*_named(columns))
    return conform(df, CONTACTS)


def price_rows(raw: DataFrame, now: Column) -> DataFrame:
    """One row per product and price list; the price is that of quantity 1."""
    lists = P.shaped(P.parse(raw), ("productId",), ("priceLists",)).select(
        P.text("productId").alias("product_id"), F.explode(P.items("priceLists")).alias("list"))
    df = P.shaped(lists, ("priceListId", "quantityPrice."), of="list").select(
        "product_id",
        P.text("priceListId", "list").alias("price_list_id"),
        _filled(P.text("quantityPrice['1']", "list")).alias("price"),
        P.present("quantityPrice", "list").alias("quantity_prices"),
        now.alias("when_upserted"),
    )
    return conform(df, PRODUCT_PRICES)


def availability_rows(raw: DataFrame, now: Column) -> DataFrame:
    """One row per product and warehouse, from maps of maps."""
    products = P.shaped(P.parse(raw), ("",)).select(F.explode(P.members("")).alias("product_id", "a"))
    stock = P.shaped(products, ("warehouses", "warehouses."), of="a").select(
        "product_id", F.explode(P.members("warehouses", "a")).alias("warehouse_id", "w"))
    df = P.shaped(stock, ("onHand",), of="w").select(
        "product_id", "warehouse_id",
        P.text("onHand", "w").alias("on_hand"), P.text("allocated", "w").alias("allocated"),
        P.text("inStock", "w").alias("in_stock"), P.text("onOrder", "w").alias("on_order"),
        now.alias("when_upserted"),
    )
    return conform(df, PRODUCT_AVAILABILITY)


def primary_suppliers(products: DataFrame) -> DataFrame:
    """(product_id, primary_supplier_id) of live products, from their payloads."""
    primary = F.from_json("raw_payload", "primarySupplierId VARIANT").getField("primarySupplierId")
    return products.filter(live()).select(
        "product_id", scalar_text(primary).try_cast("bigint").alias("primary_supplier_id")
    )


def flag_primary(suppliers: DataFrame, products: DataFrame) -> DataFrame:
    """Add is_primary; unknown products or no primary give false."""
    is_primary = F.coalesce(
        F.col("primary_supplier_id") == F.col("supplier_contact_id"), F.lit(False)
    )
    return (
        suppliers.join(primary_suppliers(products), "product_id", "left")
        .withColumn("is_primary", is_primary)
        .drop("primary_supplier_id")
    )


def supplier_rows(raw: DataFrame, products: DataFrame, now: Column) -> DataFrame:
    """One row per product and supplier, from maps of supplier id lists."""
    products_of = P.shaped(P.parse(raw), ("",)).select(F.explode(P.members("")).alias("product_id", "ids"))
    pairs = P.shaped(products_of, lists=("",), of="ids").select(
        "product_id", F.explode(P.items("", "ids")).alias("supplier_contact_id"),
    ).select(*[F.col(c).cast("string").cast("bigint").alias(c) for c in ("product_id", "supplier_contact_id")])
    return conform(flag_primary(pairs, products).withColumn("when_upserted", now), PRODUCT_SUPPLIERS)


def stock_tracked_ids(products: DataFrame) -> DataFrame:
    """Products whose availability is fetched; deleted ones included."""
    return products.filter(F.col("stock_tracked")).select("product_id")


def all_product_ids(products: DataFrame) -> DataFrame:
    return products.select("product_id")


def live_product_ids(products: DataFrame) -> DataFrame:
    return products.filter(live()).select("product_id")
