from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tradelake.plans import questions, views

T0 = datetime(2024, 1, 10)


def orders(spark, *rows):
    """(order_id, customer, channel, total, status id)"""
    return spark.createDataFrame(
        [(i, "SO", c, ch, Decimal(t), s, None, None, T0) for i, c, ch, t, s in rows],
        "order_id BIGINT, order_type_code STRING, customer_contact_id BIGINT, channel_id BIGINT, "
        "total DECIMAL(38,9), order_status_id BIGINT, order_status_name STRING, is_deleted BOOLEAN, placed_on TIMESTAMP",
    ).selectExpr(
        "*", "'R' AS reference", "placed_on AS created_on", "'PAID' AS order_payment_status",
        "'S' AS shipping_status_code", "'Co' AS customer_company_name", "'e' AS customer_email",
        "'NY' AS delivery_state", "'US' AS delivery_country_iso", "'USD' AS currency_code",
    )


def lines(spark, *rows):
    return spark.createDataFrame(
        [(i, o, Decimal(q), None if c is None else Decimal(c), Decimal(n)) for i, o, q, c, n in rows],
        "order_row_id BIGINT, order_id BIGINT, quantity DECIMAL(38,9), item_cost DECIMAL(38,9), row_net DECIMAL(38,9)",
    ).selectExpr(
        "*", "1L AS product_id", "'SKU' AS product_sku", "'P' AS product_name", "row_net AS product_price",
        "row_net AS row_tax", "'4000' AS nominal_code",
    )


def channels(spark, *rows):
    return spark.createDataFrame(list(rows), "id STRING, name STRING")


LEGACY = ("source_order_id STRING, order_date DATE, customer_id BIGINT, customer_email STRING, customer_company STRING, "
          "ship_state STRING, channel STRING, product_id BIGINT, sku STRING, product_name STRING, "
          "unit_of_measure STRING, quantity DECIMAL(38,9), line_net DECIMAL(38,9)")


@pytest.fixture
def tables(spark):
    return {
        "orders": orders(spark, (1, 10, 1, "100", 28), (2, 10, 2, "50", 28), (3, 11, 1, "70", 5), (4, 12, None, "9", 28)),
        "order_rows": lines(spark, (1, 1, "2", "1.5", "100"), (2, 2, "1", None, "50"), (3, 3, "1", "1", "70"), (4, 4, "3", "1", "9")),
        "channels": channels(spark, ("1", "Main"), ("1", "Duplicate"), ("x", "Junk"), ("2", None)),
        "contacts": spark.createDataFrame(
            [(10, "Ann", "Lee", None, "Org", 1, T0, None), (11, "Bo", None, "bo@x", None, 1, T0, None), (13, "Cy", "D", None, None, 1, T0, True)],
            "contact_id BIGINT, first_name STRING, last_name STRING, email STRING, organisation_name STRING, "
            "company_id BIGINT, created_on TIMESTAMP, is_deleted BOOLEAN"),
        "legacy_sales": spark.createDataFrame(
            [("1", date(2023, 5, 1), 10, None, None, None, "Old", 1, "SKU", "P", "YD", Decimal(4), Decimal("25"))], LEGACY),
    }


def test_duplicate_lookup_rows_do_not_multiply_sales(tables):
    rows = {r["order_row_id"]: r for r in views.sales_flat(tables).collect()}
    assert set(rows) == {1, 2, 4}
    assert rows[1]["channel_name"] == "Main" and rows[4]["channel_name"] is None
    assert rows[1]["row_cost"] == 3 and rows[1]["row_margin"] == 97
    assert rows[2]["row_cost"] is None and rows[2]["row_margin"] is None
    assert len(views.sales_flat(tables).columns) == 28


def test_customers_without_orders_stay(tables):
    rows = {r["contact_id"]: r for r in views.customer_summary(tables, views.at("2024-01-20 23:00:00")).collect()}
    assert set(rows) == {10, 11}
    assert rows[10]["order_count"] == 2 and rows[10]["lifetime_value"] == 150
    assert rows[10]["avg_order_value"] == 75 and rows[10]["days_since_last_order"] == 10
    assert rows[11]["order_count"] == 0 and rows[11]["lifetime_value"] is None


def test_unified_and_search(tables):
    assert views.sales_unified(tables).count() == 4
    rows = questions.search_customers(tables, "ann lee  ORG", views.at("2024-02-01")).collect()
    (row,) = rows
    # the eras share the order number 1: it counts once
    assert row["order_count"] == 2 and row["lifetime_value"] == Decimal("175.00")
    assert row["sources"] == "current,legacy" and row["days_since_last_order"] == 22
    (other,) = questions.search_customers(tables, "BO@", views.at("2024-02-01")).collect()
    assert other["order_count"] == 0 and other["sources"] == "" and other["last_order_on"] is None


def test_query_sales(tables):
    by_source = {r["source"]: r for r in questions.query_sales(tables, "2023-05-01", "2024-01-10", "source").collect()}
    assert by_source["legacy"]["revenue"] == 25 and by_source["current"]["orders"] == 3
    assert questions.query_sales(tables, "2023-05-02", "2024-01-09", "source").count() == 0
    assert [r["month"] for r in questions.query_sales(tables, "2020-01-01", "2030-01-01", source="legacy").collect()] == ["2023-05"]
    for bad in ({"group_by": "sql"}, {"source": "both"}, {"top_n": -5}):
        with pytest.raises(ValueError):
            questions.query_sales(tables, "2020-01-01", "2030-01-01", **bad)


def test_eras_must_not_overlap(spark, tables):
    views.assert_eras_disjoint(tables)
    late = spark.createDataFrame([("9", date(2024, 1, 10), *[None] * 11)], LEGACY)
    with pytest.raises(ValueError):
        views.assert_eras_disjoint({**tables, "legacy_sales": late})


def test_financials(spark):
    journal = spark.createDataFrame(
        [(T0, "1", "10.5", None), (T0, "1", "n/a", "3"), (T0, "2", None, "1.000000001"), (datetime(2024, 2, 1), "1", "1", None)],
        "journal_date TIMESTAMP, nominal_code STRING, journal_debit STRING, journal_credit STRING")
    codes = spark.createDataFrame([("1", "Sales", "INCOME"), ("1", "Sales", "INCOME")], "code STRING, name STRING, type STRING")
    rows = {(r["month"], r["nominal_code"]): r for r in views.monthly_financials({"journal_rows": journal, "nominal_codes": codes}).collect()}
    january = rows[date(2024, 1, 1), "1"]
    # a code listed twice counts twice, as any join would
    assert january["total_debit"] == 21 and january["net_credit"] == -15 and january["line_count"] == 4
    other = rows[date(2024, 1, 1), "2"]
    assert other["total_credit"] == Decimal("1.000000001") and other["net_credit"] is None
    assert other["nominal_name"] is None


def products(spark, *rows):
    return spark.createDataFrame([(i, "s", "n", "LIVE", 1, None, raw) for i, raw in rows],
        "product_id BIGINT, sku STRING, name STRING, status STRING, brand_id BIGINT, is_deleted BOOLEAN, raw_payload STRING")


def test_variations(spark):
    tables = {"products": products(
        spark, (1, '{"variations":[{"optionId":"3","optionName":"Color","optionValueId":4,"optionValue":"Red"},{"optionName":{"a":1}}]}'),
        (2, "{}"), (3, '{"variations":[]}'), (4, None))}
    rows = views.product_variations(tables).collect()
    assert {(r["product_id"], r["option_id"], r["option_name"], r["option_value_id"]) for r in rows} == {(1, 3, "Color", 4), (1, None, None, None)}
    junk = {"products": products(spark, (1, '{"variations":[{"optionId":"x"}]}'))}
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        views.product_variations(junk).collect()


def test_stock_view_keeps_products_without_payload_or_stock(spark):
    tables = {
        "products": products(spark, (1, None), (2, '{"customFields":{"PCF_COLLECTI":"C","PCF_SIZE":{"id":1},"PCF_UOM":5}}')),
        "product_availability": spark.createDataFrame([(2, 1, T0), (2, 2, T0)], "product_id BIGINT, warehouse_id BIGINT, when_upserted TIMESTAMP")
        .selectExpr("*", "1 AS on_hand", "0 AS allocated", "1 AS in_stock", "0 AS on_order"),
        "warehouses": spark.createDataFrame([(1, "W")], "id BIGINT, name STRING"),
        "brands": spark.createDataFrame([(1, "B")], "brand_id BIGINT, brand_name STRING"),
    }
    rows = sorted(views.inventory_position(tables).collect(), key=lambda r: (r["product_id"], r["warehouse_id"] or 0))
    assert [(r["product_id"], r["warehouse_name"]) for r in rows] == [(1, None), (2, "W"), (2, None)]
    assert rows[0]["collection"] is None
    assert rows[1]["collection"] == "C" and rows[1]["size"] is None and rows[1]["unit_of_measure"] == "5"
    assert questions.get_stock_levels(tables, "c").count() == 2
    assert questions.get_stock_levels(tables, "c", 1).count() == 1


def test_schema_listing_and_capped_answer(spark, tables):
    listing = {r["table_name"]: r["columns"] for r in questions.get_schema(spark, tables).collect()}
    assert listing["channels"] == ["id string", "name string"]
    rows, more = questions.answer(lambda n: spark.range(201))
    assert len(rows) == 200 and more
    rows, more = questions.answer(lambda n: spark.range(200))
    assert len(rows) == 200 and not more


def test_views_by_name(spark, tables):
    assert views.register_views.__doc__
    for name in ("sales_flat", "sales_unified"):
        views.VIEWS[name](tables).createOrReplaceTempView(name)
    df = questions.run_sql(spark, "SELECT count(*) AS n FROM sales_unified WHERE channel = :c", {"c": "Main"})
    assert df.first()["n"] == 1
    assert "sales_flat" in {r["table_name"] for r in questions.get_schema(spark, {}).collect()}


def test_ordered_listing(spark):
    df = spark.createDataFrame([("t", 2, "b"), ("t", 10, "c"), ("t", 1, "a")], "g STRING, p INT, x STRING")
    assert questions.ordered_listing(df, ["g"], "p", F.col("x")).first()["items"] == ["a", "b", "c"]


def test_history_by_month_is_pruned(tables, tmp_path):
    stored = tables["legacy_sales"].withColumn("order_month", F.trunc("order_date", "month"))
    stored.write.partitionBy("order_month").parquet(str(tmp_path / "h"))
    history = tables["legacy_sales"].sparkSession.read.parquet(str(tmp_path / "h"))
    df = questions.query_sales({**tables, "legacy_sales": history}, "2023-05-03", "2023-06-10", "source")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(order_month" in plan
    assert questions.query_sales({**tables, "legacy_sales": history}, "2023-05-01", "2023-06-10", "source").first()["revenue"] == 25
