"""Parameterised questions over the views."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from tradelake.functions.predicates import (
    any_column_like, joined_text, joined_text_like, live, still_open,
)
from tradelake.functions.times import utc_text
from tradelake.plans.search_index import TextIndex
from tradelake.plans.views import inventory_position, po_pipeline, sales_unified, stock_products

Tables = Mapping[str, DataFrame]

# How many rows an answer shows unless asked for more. Each
# question takes the number as a parameter; `answer` tells whether rows were
# left out.
MAX_ROWS = 200
STOCK_ROWS = 100
CUSTOMER_ROWS = 50

SOURCES = ("all", "current", "legacy")


def _rows(n: int) -> int:
    if n < 1:
        raise ValueError(f"at least one row must be asked for, not {n}")
    return n


def _dimensions() -> dict[str, Column]:
    return {
        "month": F.date_format("order_date", "yyyy-MM"),
        "product": F.col("product_name"),
        "sku": F.col("sku"),
        "customer": F.col("customer_company"),
        "channel": F.col("channel"),
        "state": F.col("ship_state"),
        "source": F.col("source"),
    }


def query_sales(
    tables: Tables,
    start_date: str,
    end_date: str,
    group_by: str = "month",
    top_n: int = 25,
    source: str = "all",
) -> DataFrame:
    """Revenue, quantity and orders per group between two dates, both included."""
    dimensions = _dimensions()
    if group_by not in dimensions:
        raise ValueError(f"group_by must be one of {list(dimensions)}")
    if source not in SOURCES:
        raise ValueError(f"source must be one of {list(SOURCES)}")
    first, last = (F.lit(d).cast("date") for d in (start_date, end_date))
    history = tables["legacy_sales"]
    if "order_month" in history.columns:  # stored by month: only the folders of the range are read
        months = F.col("order_month").between(F.trunc(first, "month"), F.trunc(last, "month"))
        tables = {**tables, "legacy_sales": history.filter(months)}
    sales = sales_unified(tables).filter(F.col("order_date").between(first, last))
    if source != "all":
        sales = sales.filter(F.col("source") == source)
    return (
        sales.groupBy(dimensions[group_by].alias(group_by))
        .agg(
            F.round(F.sum("line_net"), 2).alias("revenue"),
            F.round(F.sum("quantity"), 1).alias("quantity"),
            F.count_distinct("order_ref").alias("orders"),
        )
        .orderBy(F.desc("revenue"), F.asc(group_by))
        .limit(_rows(top_n))
    )


# The columns that are searched.
STOCK_TEXTS = ("sku", "name", "collection", "pattern")
CUSTOMER_TEXTS = ("first_name", "last_name", "email", "organisation_name")


def stock_index(tables: Tables, path: str) -> TextIndex:
    """Products indexed for `get_stock_levels`."""
    index = TextIndex(tables["products"].sparkSession, path, "product_id")
    index.build(tables["products"], stock_products(tables).select("product_id", *STOCK_TEXTS))
    return index


def customer_index(tables: Tables, path: str) -> TextIndex:
    """Contacts indexed for `search_customers`."""
    contacts = tables["contacts"]
    index = TextIndex(contacts.sparkSession, path, "contact_id")
    index.build(contacts, contacts.select("contact_id", joined_text(*CUSTOMER_TEXTS).alias("text")))
    return index


def get_stock_levels(
    tables: Tables, search: str, warehouse_id: int | None = None, max_rows: int = STOCK_ROWS,
    index: TextIndex | None = None,
) -> DataFrame:
    """Stock of products whose SKU, name, collection or pattern holds a term."""
    if index:
        tables = {**tables, "products": index.candidates(search)}
    stock = inventory_position(tables).filter(any_column_like(search, *STOCK_TEXTS))
    if warehouse_id is not None:
        stock = stock.filter(F.col("warehouse_id") == warehouse_id)
    return (
        stock.orderBy("sku", "warehouse_id", "product_id")
        .limit(_rows(max_rows))
        .select(
            "product_id", "sku", "name", "collection", "pattern", "size", "unit_of_measure",
            "warehouse_name", "on_hand", "allocated", "in_stock", "on_order",
            utc_text(F.col("stock_as_of")).alias("stock_as_of"),
        )
    )


def search_customers(
    tables: Tables, query: str, as_of: Column | None = None, max_rows: int = CUSTOMER_ROWS,
    index: TextIndex | None = None,
) -> DataFrame:
    """Customers matching a text, with lifetime figures over both eras.

    Only the matched customers' orders meet the order lines. Two flags stand
    for the set of source tags, so the totals stay a plain hash aggregate.
    """
    today = F.current_date() if as_of is None else F.to_date(as_of)
    matched = (
        (index.candidates(query) if index else tables["contacts"])
        .filter(live())
        .filter(joined_text_like(query, *CUSTOMER_TEXTS))
        .select("contact_id", *CUSTOMER_TEXTS)
    )

    def of_matched(name: str, customer: str) -> DataFrame:
        ids = matched.select(F.col("contact_id").alias(customer))
        return tables[name].join(ids, customer, "left_semi")

    sales = sales_unified({
        "orders": of_matched("orders", "customer_contact_id"),
        "order_rows": tables["order_rows"],
        "channels": tables["channels"],
        "legacy_sales": of_matched("legacy_sales", "customer_id"),
    })
    tags = sorted(s for s in SOURCES if s != "all")
    stats = (
        sales.groupBy(F.col("customer_id").alias("contact_id"))
        .agg(
            F.count_distinct("order_ref").alias("order_count"),
            F.round(F.sum("line_net"), 2).alias("lifetime_value"),
            F.max("order_date").alias("last_order_on"),
            *[F.max(F.col("source") == tag).alias(tag) for tag in tags],
        )
        .withColumn("sources", F.concat_ws(",", *[F.when(F.col(tag), F.lit(tag)) for tag in tags]))
        .drop(*tags)
    )
    return (
        matched.join(stats, "contact_id", "left")
        .select(
            *matched.columns,
            F.coalesce("order_count", F.lit(0)).alias("order_count"),
            F.coalesce("lifetime_value", F.lit(0)).alias("lifetime_value"),
            F.col("last_order_on").cast("string").alias("last_order_on"),
            F.datediff(today, F.col("last_order_on")).alias("days_since_last_order"),
            F.coalesce("sources", F.lit("")).alias("sources"),
        )
        .orderBy(F.desc_nulls_last("lifetime_value"), "contact_id")
        .limit(_rows(max_rows))
    )


def get_po_pipeline(tables: Tables, supplier: str | None = None, max_rows: int = MAX_ROWS) -> DataFrame:
    """Lines of open purchase orders, newest first."""
    lines = po_pipeline(tables).filter(still_open())
    if supplier:
        lines = lines.filter(any_column_like(supplier, "supplier_name"))
    return (
        lines.withColumn("placed_on", utc_text(F.col("placed_on")))
        .orderBy(
            F.desc("placed_on"), "order_id", "order_row_id", "product_sku", "quantity",
            "row_net", "unit_cost",
        )
        .limit(_rows(max_rows))
        .select(
            "order_id", "reference", "supplier_name", "order_status_name", "placed_on",
            "warehouse_name", "product_sku", "product_name", "quantity", "unit_cost", "row_net",
        )
    )


def ordered_listing(df: DataFrame, group: list[str], position: str, text: Column) -> DataFrame:
    """Per group the texts in position order. For groups of bounded size only."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(position).alias("pos"), text.alias("text"))))
    return df.groupBy(*group).agg(F.transform(entries, lambda e: e["text"]).alias("items"))


def catalog_columns(spark: SparkSession, tables: Tables) -> DataFrame:
    """(table_name, column_name, data_type, ordinal_position) of tables and views."""
    frames = dict(tables.items())
    for entry in spark.catalog.listTables():
        frames.setdefault(entry.name, spark.table(entry.name))
    rows = [
        (name, field.name, field.dataType.simpleString(), i)
        for name, df in frames.items()
        for i, field in enumerate(df.schema.fields, 1)
    ]
    return spark.createDataFrame(
        rows, "table_name STRING, column_name STRING, data_type STRING, ordinal_position INT"
    )


def get_schema(spark: SparkSession, tables: Tables) -> DataFrame:
    """Every table and view with its columns and types in order."""
    text = F.concat_ws(" ", "column_name", "data_type")
    return (
        ordered_listing(catalog_columns(spark, tables), ["table_name"], "ordinal_position", text)
        .withColumnRenamed("items", "columns")
        .orderBy("table_name")
    )


def answer(question: Callable[[int], DataFrame], max_rows: int = MAX_ROWS) -> tuple[list[Row], bool]:
    """The rows to show and whether more exist. Never fetches more than one extra.

    `question` makes the frame for a number of rows, so the extra one is asked for too.
    """
    rows = question(max_rows + 1).limit(max_rows + 1).collect()
    return rows[:max_rows], len(rows) > max_rows


def run_sql(spark: SparkSession, text: str, args: dict | None = None) -> DataFrame:
    """A SELECT over the registered views, with bound parameters."""
    return spark.sql(text, args=args or {})
