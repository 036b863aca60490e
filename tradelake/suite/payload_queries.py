"""Payload projections over payloads made from the whole ERP tables.

An order's lines, a product's warehouses and suppliers, and a page's rows are
gathered into one payload; each is a small group whatever the size of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tradelake.operators import projections
from tradelake.session import work_folder
from tradelake.sources.pages import page_columns, page_rows
from tradelake.sources.payloads import read_payloads
from tradelake.sources.reference_items import reference_rows
from tradelake.sources.testdata import ErpTables
from tradelake.suite.common import plain, sql_time, with_adapters

NOW = "2002-01-01 00:00:00"


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def iso(ts: str | Column) -> Column:
    """Noon of a day, five hours west of UTC, as ISO text."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd"), F.lit("T12:00:00.000-05:00"))


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def order_payloads(t: ErpTables) -> DataFrame:
    """(id, raw_payload): one order header with one line each."""
    order_id = F.col("order_id")
    paid = F.col("order_payment_status") == "PAID"
    line = F.struct(
        F.lit("10").alias("orderRowSequence"),
        F.col("customer_contact_id").alias("productId"),
        F.struct(_text("total").alias("value")).alias("itemCost"),
        F.struct(F.lit("1.0000").alias("magnitude")).alias("quantity"),
    )
    payload = F.struct(
        order_id.alias("id"),
        (order_id % 3).alias("parentOrderId"),
        F.col("order_type_code").alias("orderTypeCode"),
        "reference",
        F.struct(
            F.col("order_status_id").alias("orderStatusId"), F.col("order_status_name").alias("name")
        ).alias("orderStatus"),
        F.col("order_payment_status").alias("orderPaymentStatus"),
        iso("placed_on").alias("placedOn"),
        iso("updated_on").alias("updatedOn"),
        F.struct(
            F.col("currency_code").alias("orderCurrencyCode"), F.lit("1.000000").alias("exchangeRate")
        ).alias("currency"),
        F.struct(
            F.when(paid, _text("total")).otherwise(F.lit("")).alias("net"),
            _text("total").alias("total"),
        ).alias("totalValue"),
        F.struct(
            F.struct(F.col("channel_id").alias("channelId"), F.lit(0).alias("staffOwnerContactId"))
            .alias("current")
        ).alias("assignment"),
        F.struct(
            F.struct(
                F.col("customer_contact_id").alias("contactId"),
                F.col("customer_company_name").alias("companyName"),
                F.col("customer_email").alias("email"),
            ).alias("customer"),
            F.when(paid, F.struct(F.col("delivery_state").alias("addressLine4"))).alias("delivery"),
        ).alias("parties"),
        F.when(paid, F.array(F.struct(F.concat(F.lit("SI-"), _text("order_id")).alias("invoiceReference"))))
        .otherwise(F.array().cast("array<struct<invoiceReference:string>>")).alias("invoices"),
        F.col("warehouse_id").alias("warehouseId"),
        paid.alias("historicalOrder"),
        F.create_map((order_id * 10).cast("string"), line).alias("orderRows"),
    )
    # The test tables are one row group each, hence one task. A given number of parts is
    # not merged by size: short rows are long work here.
    orders = t["orders"]
    parts = int(orders.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return orders.repartition(parts).select(order_id.alias("id"), F.to_json(payload).alias("raw_payload"))


def _gathered(key: Column, value: Column) -> Column:
    """The members of a group as the text of one JSON object."""
    member = F.concat(F.lit('"'), key, F.lit('":'), F.to_json(value))
    return F.concat(F.lit("{"), F.array_join(F.collect_list(member), ","), F.lit("}"))


def line_payloads(t: ErpTables) -> DataFrame:
    """One order payload per order, holding all its lines."""
    line = F.struct(
        F.when(F.col("row_sequence") == 1, F.lit("")).otherwise(_text("row_sequence"))
        .alias("orderRowSequence"),
        F.col("product_id").alias("productId"),
        F.col("product_name").alias("productName"),
        F.col("product_sku").alias("productSku"),
        F.struct(_text("quantity").alias("magnitude")).alias("quantity"),
        F.when(F.col("item_cost").isNotNull(), F.struct(_text("item_cost").alias("value"))).alias("itemCost"),
        F.struct(_text("product_price").alias("value")).alias("productPrice"),
        F.struct(
            _text("tax_rate").alias("taxRate"), F.lit("N").alias("taxCode"),
            F.struct(_text("row_net").alias("value")).alias("rowNet"),
            F.struct(F.lit("").alias("value")).alias("rowTax"),
        ).alias("rowValue"),
        F.when(F.col("row_sequence") > 3, F.create_map(F.lit("Color"), F.col("nominal_code"), F.lit("quantity"), F.lit("")))
        .otherwise(F.create_map().cast("map<string,string>")).alias("productOptions"),
        F.col("nominal_code").alias("nominalCode"),
        F.struct(
            (F.col("row_sequence") == 2).alias("bundleParent"),
            (F.col("row_sequence") - 1).alias("parentOrderRowId"),
        ).alias("composition"),
    )
    # a line id that repeats in an order goes to a further payload of it
    nth = F.row_number().over(Window.partitionBy("order_id", "order_row_id").orderBy("product_id"))
    orders = t["order_rows"].withColumn("nth", nth).groupBy("order_id", "nth").agg(
        _gathered(_text("order_row_id"), line).alias("orderRows"))
    changed = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("order_id") % 1000).cast("int"))
    head = F.concat(F.lit('{"id":'), _text("order_id"), F.lit(',"updatedOn":"'), iso(changed), F.lit('","orderRows":'))
    return orders.select(F.concat(head, "orderRows", F.lit("}")).alias("raw_payload"))


def product_payloads(t: ErpTables) -> DataFrame:
    live = F.col("status") == "LIVE"
    payload = F.struct(
        F.col("product_id").alias("id"),
        F.col("brand_id").alias("brandId"),
        F.struct("sku", F.lit("").alias("barcode")).alias("identity"),
        F.struct(
            F.col("stock_tracked").alias("stockTracked"),
            F.struct((F.col("product_id") / 4).alias("magnitude")).alias("weight"),
        ).alias("stock"),
        F.when(live, F.array(F.struct(F.concat(F.lit("New "), "name").alias("productName"))))
        .alias("salesChannels"),
        F.struct((F.col("brand_id") > 10).alias("bundle")).alias("composition"),
        F.lit("4000").alias("nominalCodeSales"),
        "status",
        F.lit("2007-05-29T06:42:08.000-04:00").alias("createdOn"),
    )
    return t["products"].select(F.col("product_id").alias("id"), F.to_json(payload).alias("raw_payload"))


def contact_payloads(t: ErpTables) -> DataFrame:
    payload = F.struct(
        F.col("contact_id").alias("contactId"),
        F.col("first_name").alias("firstName"),
        F.col("last_name").alias("lastName"),
        F.struct(
            F.create_map(
                F.when(F.col("company_id") == 3, F.lit("SEC")).otherwise(F.lit("PRI")),
                F.struct("email"),
            ).alias("emails"),
            F.create_map(F.lit("PRI"), F.concat(F.lit("555-"), _text("contact_id"))).alias("telephones"),
        ).alias("communication"),
        F.struct((F.col("company_id") > 12).alias("isSupplier")).alias("relationshipToAccount"),
        F.struct(F.lit(30).alias("creditTermDays")).alias("financialDetails"),
        F.struct(F.col("organisation_name").alias("name")).alias("organisation"),
        F.lit("0,12").alias("contactTags"),
        F.col("company_id").alias("companyId"),
        F.lit("2026-04-23T15:49:22.000-04:00").alias("updatedOn"),
    )
    return t["contacts"].select(F.col("contact_id").alias("id"), F.to_json(payload).alias("raw_payload"))


def price_payloads(t: ErpTables) -> DataFrame:
    price = F.col("p_retailprice").cast("decimal(18,2)").cast("string")
    empty = F.create_map().cast("map<string,string>")
    lists = F.array(
        F.struct(F.lit(1).alias("priceListId"), F.create_map(F.lit("1"), price, F.lit("10"), F.lit("5.00")).alias("quantityPrice")),
        F.struct(F.lit(2).alias("priceListId"), F.create_map(F.lit("10"), price).alias("quantityPrice")),
        F.struct(F.lit(3).alias("priceListId"), empty.alias("quantityPrice")),
        F.struct(F.lit(4).alias("priceListId"), F.create_map(F.lit("1"), F.lit("")).alias("quantityPrice")),
    )
    lists = F.when(F.col("p_size") > 5, lists)
    payload = F.struct(F.col("p_partkey").alias("productId"), lists.alias("priceLists"))
    return t.base("part").select(F.to_json(payload).alias("raw_payload"))


def availability_payloads(t: ErpTables) -> DataFrame:
    amounts = F.struct(
        _text("on_hand").alias("onHand"), _text("allocated").alias("allocated"),
        _text("in_stock").alias("inStock"), _text("on_order").alias("onOrder"),
    )
    products = t["product_availability"].groupBy("product_id").agg(
        _gathered(_text("warehouse_id"), amounts).alias("warehouses"))
    payload = F.concat(F.lit('{"'), _text("product_id"), F.lit('":{"warehouses":'), "warehouses", F.lit("}}"))
    return products.select("product_id", payload.alias("raw_payload"))


def supplier_payloads(t: ErpTables) -> DataFrame:
    others = F.when(F.col("supplier_contact_id") != 7, _text("supplier_contact_id"))
    products = t["product_suppliers"].groupBy("product_id").agg(F.sort_array(F.collect_list(others)).alias("ids"))
    # Products without any are JSON null, or an empty text: they give no rows.
    ids = F.when(F.size("ids") > 0, F.to_json("ids")).when(F.col("product_id") % 2 == 0, "null").otherwise('""')
    payload = F.concat(F.lit('{"'), _text("product_id"), F.lit('":'), ids, F.lit("}"))
    return products.select("product_id", payload.alias("raw_payload"))


def _projection(payloads, rows, *columns: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return plain(rows(payloads(ErpTables(spark, d)), now()).select(*columns))

    return query


def _supplier_fanout(spark: SparkSession, d: str) -> DataFrame:
    t = ErpTables(spark, d)
    rows = projections.supplier_rows(supplier_payloads(t), t["products"], now())
    return plain(rows.drop("when_upserted"))


def _primary_supplier_flag(spark: SparkSession, d: str) -> DataFrame:
    t = ErpTables(spark, d)
    return plain(projections.flag_primary(t["product_suppliers"], t["products"]))


PAGE_COLUMNS = (
    '[{"name":"journalRowId","reportDataType":"INTEGER"},{"name":"tagIds","reportDataType":"IDSET"},'
    '{"name":"journalDebit","reportDataType":"MONEY"},{"name":"isReconciled","reportDataType":"BOOLEAN"},'
    '{"name":"updatedOn","reportDataType":"DATETIME"},{"name":"nominalCode","reportDataType":"SEARCH_STRING"},'
    '{"name":"orderRef","reportDataType":"UNKNOWN"}]'
)


#: Orders whose ledger lines make up one page.
PAGE_ORDERS = 100


def journal_pages(t: ErpTables) -> DataFrame:
    """Ledger lines in result pages; some rows are short, some too long."""
    number = F.col("journal_row_id") % 10
    cells = [
        _text("journal_row_id"),
        F.when(number < 4, F.concat(F.lit("["), _text("journal_row_id"), F.lit("]"))).otherwise("[1,2]"),
        F.concat(F.lit('"'), F.when(F.col("journal_debit") == "n/a", "").otherwise(F.coalesce("journal_debit", F.lit(""))), F.lit('"')),
        F.when(number == 1, "true").when(number == 2, '" YES "').when(number == 3, "0")
        .when(number == 4, '""').when(number == 5, '"no"').otherwise("null"),
        F.concat(F.lit('"'), F.date_format("journal_date", "yyyy-MM-dd"), F.lit('T12:00-05:00"')),
        F.col("nominal_code"),
    ]
    tail = F.when(number == 7, "").when(number == 6, ',{"a":1},"extra"').otherwise(',"x"')
    row = F.concat(F.lit("["), F.concat_ws(",", *cells), tail, F.lit("]"))
    number = (F.col("journal_row_id") / (1000 * PAGE_ORDERS)).cast("bigint")
    rows = t["journal_rows"].groupBy(number.alias("number")).agg(F.collect_list(row).alias("rows"))
    page = F.concat(
        F.lit(f'{{"metaData":{{"columns":{PAGE_COLUMNS}}},"results":['), F.array_join("rows", ","), F.lit("]}"))
    return rows.select(page.alias("page"))


def _search_page_typed(spark: SparkSession, d: str) -> DataFrame:
    # Written once: names and types of columns are read before the rows are.
    folder = work_folder(spark, "journal-pages")
    journal_pages(ErpTables(spark, d)).write.parquet(folder)
    pages = spark.read.parquet(folder)
    return plain(page_rows(pages, page_columns(pages), now()).drop("when_upserted"))


def reference_payloads(t: ErpTables) -> DataFrame:
    """Collections of every shape, one per part, by its size."""
    key, name = _text("p_partkey"), F.col("p_name")
    shape = F.col("p_size") % 6
    item = F.concat(F.lit('{"channelBrandId":6,"id":'), key, F.lit(',"name":"'), name, F.lit('"}'))
    tag = F.concat(F.lit('{"tagColor":"#0","tagId":'), key, F.lit(',"tagName":"'), name, F.lit('","tagParentId":0}'))
    nested = F.concat(F.lit('{"code":"'), F.col("p_brand"), F.lit('","currencyId":1,"id":"P'), key, F.lit('","name":{"text":"Cost"}}'))
    payload = (
        F.when(shape == 0, F.concat(F.lit("["), item, F.lit(',"junk",5,'), nested, F.lit("]")))
        .when(shape == 1, F.concat(F.lit('{"1":'), tag, F.lit(',"38":'), item, F.lit("}")))
        .when(shape == 2, nested)
        .when(shape == 3, F.lit('{"statusId":4,"name":{"text":"Cost"},"detail":{"a":1}}'))
        .when(shape == 4, F.lit("null"))
        .otherwise(F.lit("[]"))
    )
    return t.base("part").select(payload.alias("payload"))


def _reference_items(spark: SparkSession, d: str) -> DataFrame:
    rows = reference_rows(reference_payloads(ErpTables(spark, d)), now())
    return plain(rows.select("id", "name"))


HEADER_COLUMNS = (
    "order_id", "parent_order_id", "order_type_code", "reference", "order_status_id",
    "order_status_name", "order_payment_status", "placed_on", "updated_on", "closed_on",
    "customer_contact_id", "customer_company_name", "customer_email", "delivery_state",
    "warehouse_id", "channel_id", "staff_owner_contact_id", "currency_code", "exchange_rate",
    "total_net", "total", "invoice_reference", "historical_order", "is_deleted", "when_upserted",
)


def _payload_files(spark: SparkSession, d: str) -> DataFrame:
    """Orders as JSON files of answers with up to 100 records, read back and projected."""
    folder = work_folder(spark, "payload-files")
    number = (F.col("id") / 400).cast("bigint")
    answers = order_payloads(ErpTables(spark, d)).groupBy(number.alias("number")).agg(F.collect_list("raw_payload").alias("r"))
    answers.select(F.concat(F.lit('{"response":['), F.array_join("r", ","), F.lit("]}"))).write.text(folder)
    return plain(projections.order_headers(read_payloads(spark, folder), now()).select(*HEADER_COLUMNS))


QUERIES = {
    "payload_order_header": _projection(order_payloads, projections.order_headers, *HEADER_COLUMNS),
    "payload_files_order_header": _payload_files,
    "payload_order_lines": _projection(
        line_payloads, projections.order_lines,
        "order_row_id", "order_id", "row_sequence", "product_id", "product_name", "product_sku",
        "quantity", "item_cost", "product_price", "row_net", "row_tax", "tax_rate", "tax_code",
        "nominal_code", "bundle_parent", "bundle_child", "parent_order_row_id", "product_options",
        "order_updated_on",
    ),
    "payload_product": _projection(
        product_payloads, projections.product_rows,
        "product_id", "sku", "barcode", "name", "status", "brand_id", "stock_tracked", "weight",
        "is_bundle", "nominal_code_sales", "created_on", "is_deleted",
    ),
    "payload_contact": _projection(
        contact_payloads, projections.contact_rows,
        "contact_id", "first_name", "last_name", "email", "telephone", "company_id",
        "organisation_name", "is_supplier", "is_staff", "credit_term_days", "contact_tags",
        "updated_on",
    ),
    "price_fanout": _projection(
        price_payloads, projections.price_rows,
        "product_id", "price_list_id", "price", "quantity_prices",
    ),
    "availability_fanout": _projection(
        availability_payloads, projections.availability_rows,
        "product_id", "warehouse_id", "on_hand", "allocated", "in_stock", "on_order",
    ),
    "supplier_fanout": _supplier_fanout,
    "primary_supplier_flag": _primary_supplier_flag,
    "search_page_typed": _search_page_typed,
    "reference_items": _reference_items,
}

_PRIMARY = """primaries AS (
  SELECT product_id, TRY_CAST(raw_payload ->> '$.primarySupplierId' AS BIGINT) AS primary_id
  FROM erp_products WHERE is_deleted IS DISTINCT FROM TRUE)"""

_ORDER_HEADER_SQL = with_adapters("erp_orders", select=f"""
SELECT order_id, nullif(order_id % 3, 0) AS parent_order_id, order_type_code, reference, order_status_id,
  order_status_name, order_payment_status,
  {sql_time("placed_on + INTERVAL 17 HOUR")} AS placed_on, {sql_time("placed_on + INTERVAL 17 HOUR")} AS updated_on,
  CAST(NULL AS VARCHAR) AS closed_on, customer_contact_id, customer_company_name, customer_email,
  CASE WHEN order_payment_status = 'PAID' THEN delivery_state END AS delivery_state, warehouse_id, channel_id,
  CAST(0 AS BIGINT) AS staff_owner_contact_id, currency_code, CAST(1 AS DOUBLE) AS exchange_rate,
  CASE WHEN order_payment_status = 'PAID' THEN CAST(total AS DOUBLE) END AS total_net,
  CAST(total AS DOUBLE) AS total,
  CASE WHEN order_payment_status = 'PAID' THEN 'SI-' || order_id END AS invoice_reference,
  order_payment_status = 'PAID' AS historical_order, FALSE AS is_deleted, '{NOW}' AS when_upserted
FROM erp_orders""")

ORACLES = {
    "payload_order_header": _ORDER_HEADER_SQL,
    "payload_files_order_header": _ORDER_HEADER_SQL,
    "payload_order_lines": with_adapters("erp_order_rows", select=f"""
SELECT order_row_id, order_id, nullif(row_sequence, 1) AS row_sequence, product_id, product_name, product_sku,
  CAST(quantity AS DOUBLE) AS quantity, CAST(item_cost AS DOUBLE) AS item_cost,
  CAST(product_price AS DOUBLE) AS product_price, CAST(row_net AS DOUBLE) AS row_net,
  CAST(NULL AS DOUBLE) AS row_tax, CAST(tax_rate AS DOUBLE) AS tax_rate, 'N' AS tax_code, nominal_code,
  row_sequence = 2 AS bundle_parent, CAST(NULL AS BOOLEAN) AS bundle_child,
  nullif(row_sequence - 1, 0) AS parent_order_row_id,
  CASE WHEN row_sequence > 3 THEN '{{"Color":"' || nominal_code || '","quantity":""}}' END AS product_options,
  {sql_time("DATE '1995-01-01' + CAST(order_id % 1000 AS INTEGER) + INTERVAL 17 HOUR")} AS order_updated_on
FROM erp_order_rows"""),
    "payload_product": with_adapters("erp_products", select="""
SELECT product_id, sku, '' AS barcode, CASE WHEN status = 'LIVE' THEN 'New ' || name END AS name, status,
  brand_id, stock_tracked, product_id / 4 AS weight, brand_id > 10 AS is_bundle, '4000' AS nominal_code_sales,
  '2007-05-29 10:42:08' AS created_on, FALSE AS is_deleted FROM erp_products"""),
    "payload_contact": with_adapters("erp_contacts", select="""
SELECT contact_id, first_name, last_name, CASE WHEN company_id <> 3 THEN email END AS email,
  '555-' || contact_id AS telephone, company_id, organisation_name, company_id > 12 AS is_supplier,
  CAST(NULL AS BOOLEAN) AS is_staff, CAST(30 AS BIGINT) AS credit_term_days, '0,12' AS contact_tags,
  '2026-04-23 19:49:22' AS updated_on FROM erp_contacts"""),
    "price_fanout": """
WITH parts AS (SELECT *, CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) AS price FROM part WHERE p_size > 5)
SELECT p_partkey AS product_id, CAST(1 AS BIGINT) AS price_list_id, CAST(price AS DOUBLE) AS price,
  '{"1":"' || price || '","10":"5.00"}' AS quantity_prices FROM parts
UNION ALL SELECT p_partkey, 2, NULL, '{"10":"' || price || '"}' FROM parts
UNION ALL SELECT p_partkey, 3, NULL, NULL FROM parts
UNION ALL SELECT p_partkey, 4, NULL, '{"1":""}' FROM parts""",
    "availability_fanout": with_adapters("erp_availability", select="""
SELECT product_id, warehouse_id, CAST(on_hand AS DOUBLE) AS on_hand, CAST(allocated AS DOUBLE) AS allocated,
  CAST(in_stock AS DOUBLE) AS in_stock, CAST(on_order AS DOUBLE) AS on_order FROM erp_availability"""),
    "supplier_fanout": with_adapters("erp_product_suppliers erp_products", _PRIMARY, select="""
SELECT s.product_id, s.supplier_contact_id, coalesce(p.primary_id = s.supplier_contact_id, FALSE) AS is_primary
FROM erp_product_suppliers s LEFT JOIN primaries p ON p.product_id = s.product_id
WHERE s.supplier_contact_id <> 7"""),
    "primary_supplier_flag": with_adapters("erp_product_suppliers erp_products", _PRIMARY, select="""
SELECT s.product_id, s.supplier_contact_id, coalesce(p.primary_id = s.supplier_contact_id, FALSE) AS is_primary
FROM erp_product_suppliers s LEFT JOIN primaries p ON p.product_id = s.product_id"""),
    "search_page_typed": with_adapters("erp_journal_rows", select=f"""
SELECT journal_row_id, CASE WHEN journal_row_id % 10 < 4 THEN journal_row_id END AS tag_ids,
  CAST(TRY_CAST(journal_debit AS DECIMAL(18,2)) AS DOUBLE) AS journal_debit,
  CASE journal_row_id % 10 WHEN 1 THEN TRUE WHEN 2 THEN TRUE WHEN 3 THEN FALSE WHEN 5 THEN FALSE END AS is_reconciled,
  {sql_time("journal_date + INTERVAL 17 HOUR")} AS updated_on, nominal_code,
  CASE journal_row_id % 10 WHEN 7 THEN NULL WHEN 6 THEN '{{"a":1}}' ELSE 'x' END AS order_ref
FROM erp_journal_rows"""),
    "reference_items": """
SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name FROM part WHERE p_size % 6 = 0
UNION ALL SELECT 'P' || p_partkey, p_brand FROM part WHERE p_size % 6 IN (0, 2)
UNION ALL SELECT CAST(p_partkey AS VARCHAR), p_name FROM part WHERE p_size % 6 = 1
UNION ALL SELECT CAST(p_partkey AS VARCHAR), p_name FROM part WHERE p_size % 6 = 1
UNION ALL SELECT '4', 'Cost' FROM part WHERE p_size % 6 = 3""",
}
