"""ERP tables derived from the driver's star-schema tables.

Each adapter is SQL over whole base tables and runs unchanged in Spark and in
DuckDB. A name in braces is a base table.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

# The day the current system took over; older orders belong to the legacy era.
CUTOVER = "DATE '1997-01-01'"

_ORDER_COLUMNS = """
SELECT o_orderkey AS order_id,
  CASE WHEN o_orderkey % 10 = 0 THEN 'PO' ELSE 'SO' END AS order_type_code,
  concat('REF-', CAST(o_orderkey AS STRING)) AS reference,
  CASE WHEN o_orderstatus = 'F' THEN 'Completed' WHEN o_orderstatus = 'O' THEN 'Invoiced'
       WHEN o_orderpriority = '1-URGENT' THEN 'Pending - Quote'
       WHEN o_orderpriority = '2-HIGH' THEN 'Cancelled'
       WHEN o_orderpriority = '3-MEDIUM' THEN NULL
       WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Draft PO' ELSE 'Shipped' END AS order_status_name,
  CAST(CASE WHEN o_orderstatus = 'F' THEN 28 WHEN o_orderstatus = 'O' THEN 4
       WHEN o_orderpriority = '1-URGENT' THEN 1 WHEN o_orderpriority = '2-HIGH' THEN 5
       WHEN o_orderpriority = '3-MEDIUM' THEN (CASE WHEN o_orderkey % 2 = 0 THEN 38 ELSE NULL END)
       WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 6 ELSE 12 END AS BIGINT) AS order_status_id,
  CASE WHEN o_orderkey % 97 = 0 THEN TRUE WHEN o_orderkey % 3 = 0 THEN FALSE ELSE NULL END AS is_deleted,
  CAST(o_orderdate AS TIMESTAMP) AS placed_on, CAST(o_orderdate AS TIMESTAMP) AS created_on,
  CAST(o_orderdate AS TIMESTAMP) AS updated_on, CAST(o_orderdate AS TIMESTAMP) AS when_upserted,
  o_custkey AS customer_contact_id,
  concat('Company ', CAST(o_custkey % 400 AS STRING)) AS customer_company_name,
  CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE concat('c', CAST(o_custkey AS STRING), '@example.com') END AS customer_email,
  concat('State ', CAST(o_custkey % 50 AS STRING)) AS delivery_state,
  'US' AS delivery_country_iso,
  CASE WHEN o_orderstatus = 'F' THEN 'PAID' ELSE 'UNPAID' END AS order_payment_status,
  CASE WHEN o_orderstatus = 'F' THEN 'SSS' ELSE 'SNS' END AS shipping_status_code,
  CASE WHEN o_orderstatus = 'O' THEN 'POR' ELSE 'PON' END AS stock_status_code,
  CAST(o_custkey % 6 AS BIGINT) AS channel_id, CAST(o_orderkey % 3 AS BIGINT) AS warehouse_id,
  CAST(o_custkey % 10 AS BIGINT) AS supplier_contact_id,
  'USD' AS currency_code, CAST(o_totalprice AS DECIMAL(18,2)) AS total,
  CASE WHEN o_custkey % 10 = 9 THEN '{{"parties":{{}}}}' ELSE
    concat('{{"parties":{{"supplier":{{"contactId":', CAST(o_custkey % 10 AS STRING),
      ',"companyName":"Supplier ', CAST(o_custkey % 10 AS STRING), '"}}}}}}') END AS raw_payload
FROM {orders}
"""

ADAPTERS = {
    "erp_orders": _ORDER_COLUMNS,
    "erp_current_orders": _ORDER_COLUMNS + f"WHERE o_orderdate >= {CUTOVER}",
    "erp_order_rows": """
SELECT l_orderkey * 10 + l_linenumber AS order_row_id, l_orderkey AS order_id,
  CAST(l_linenumber AS BIGINT) AS row_sequence, l_partkey AS product_id,
  concat('SKU-', CAST(l_partkey AS STRING)) AS product_sku,
  concat('Item ', CAST(l_partkey % 500 AS STRING)) AS product_name,
  CAST(l_quantity AS DECIMAL(18,4)) AS quantity,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_suppkey % 50 + 1 AS DECIMAL(18,4)) END AS item_cost,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS product_price,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS row_net,
  CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(18,2)) AS row_tax,
  CAST(l_tax AS DECIMAL(18,2)) AS tax_rate,
  concat('4', CAST(l_suppkey % 10 AS STRING)) AS nominal_code,
  CAST(l_shipdate AS TIMESTAMP) AS when_upserted
FROM {lineitem}
""",
    "erp_channels": """
SELECT CAST(r_regionkey AS STRING) AS id, r_name AS name FROM {region}
UNION ALL SELECT CAST(r_regionkey AS STRING) AS id, r_name AS name FROM {region} WHERE r_regionkey = 1
UNION ALL SELECT 'n/a' AS id, 'JUNK' AS name
""",
    "erp_products": """
SELECT p_partkey AS product_id, concat(p_brand, '-', CAST(p_partkey AS STRING)) AS sku,
  p_name AS name, CASE WHEN p_size % 5 = 0 THEN 'ARCHIVED' ELSE 'LIVE' END AS status,
  CAST(substr(p_brand, 7) AS BIGINT) AS brand_id, p_partkey % 4 <> 0 AS stock_tracked,
  CASE WHEN p_partkey % 89 = 0 THEN TRUE ELSE NULL END AS is_deleted,
  concat('{{"customFields":{{"PCF_COLLECTI":"', p_type, '","PCF_SIZE":"', CAST(p_size AS STRING),
    '","PCF_PATTERN":{{"id":', CAST(p_size AS STRING), '}}}},"primarySupplierId":', CAST(p_partkey % 10 AS STRING),
    CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat(
      ',"variations":[{{"optionId":1,"optionName":"Type","optionValueId":', CAST(p_size AS STRING),
      ',"optionValue":"', p_type, '"}},{{"optionId":2,"optionName":"Brand","optionValueId":',
      substr(p_brand, 7), ',"optionValue":"', p_brand, '"}}]') END, '}}') AS raw_payload
FROM {part}
""",
    "erp_contacts": """
SELECT c_custkey AS contact_id, c_mktsegment AS first_name, c_name AS last_name,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE concat('c', CAST(c_custkey AS STRING), '@example.com') END AS email,
  concat(c_mktsegment, ' Co') AS organisation_name,
  CAST(c_nationkey AS BIGINT) AS company_id, TIMESTAMP '1994-06-01 00:00:00' AS created_on,
  CASE WHEN c_custkey % 50 = 0 THEN TRUE ELSE NULL END AS is_deleted
FROM {customer}
""",
    "erp_availability": """
SELECT l_partkey AS product_id, CAST(l_suppkey % 3 AS BIGINT) AS warehouse_id,
  SUM(CAST(l_quantity AS DECIMAL(18,4))) AS on_hand,
  SUM(CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS DECIMAL(18,4)) ELSE 0 END) AS allocated,
  SUM(CASE WHEN l_returnflag = 'N' THEN 0 ELSE CAST(l_quantity AS DECIMAL(18,4)) END) AS in_stock,
  SUM(CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS DECIMAL(18,4)) ELSE 0 END) AS on_order,
  MAX(CAST(l_shipdate AS TIMESTAMP)) AS when_upserted
FROM {lineitem} GROUP BY l_partkey, l_suppkey % 3
""",
    "erp_warehouses": """
SELECT CASE WHEN r_regionkey = 2 THEN 102 ELSE CAST(r_regionkey AS BIGINT) END AS id, concat('Warehouse ', r_name) AS name
FROM {region}
""",
    "erp_brands": """
SELECT CAST(n_nationkey AS BIGINT) AS brand_id, concat('Brand of ', n_name) AS brand_name FROM {nation}
""",
    "erp_nominal_codes": """
SELECT concat(CASE WHEN n_nationkey < 8 THEN '4' ELSE '9' END, CAST(n_nationkey AS STRING)) AS code, concat('Account ', n_name) AS name,
  CASE WHEN n_regionkey = 0 THEN 'INCOME' WHEN n_regionkey = 1 THEN NULL ELSE 'EXPENSE' END AS type
FROM {nation}
""",
    "erp_product_suppliers": """
SELECT DISTINCT l_partkey AS product_id, l_suppkey % 10 AS supplier_contact_id FROM {lineitem}
""",
    "erp_journal_rows": """
SELECT l_orderkey * 1000 + l_linenumber AS journal_row_id, CAST(l_shipdate AS TIMESTAMP) AS journal_date,
  concat('4', CAST(l_suppkey % 10 AS STRING)) AS nominal_code,
  CASE WHEN l_returnflag = 'R' THEN CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING)
       WHEN l_returnflag = 'N' THEN 'n/a' ELSE NULL END AS journal_debit,
  CASE WHEN l_returnflag = 'A' THEN CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING) ELSE NULL END AS journal_credit
FROM {lineitem}
""",
    "erp_change_events": """
SELECT event_id, ts,
  CASE event_type WHEN 'purchase' THEN 'order' WHEN 'view' THEN 'product' WHEN 'signup' THEN 'contact'
       WHEN 'click' THEN 'goods-out-note' ELSE 'unknown' END AS resource,
  concat(CAST(user_id AS STRING), ',', CAST(event_id % 100 AS STRING), ',x') AS id,
  CASE WHEN event_id % 50 = 0 THEN 'destroyed' ELSE 'modified' END AS event
FROM {events}
""",
    "erp_run_log": """
SELECT event_id AS run_id,
  CASE event_type WHEN 'purchase' THEN 'orders' WHEN 'view' THEN 'products' WHEN 'signup' THEN 'contacts'
       WHEN 'click' THEN 'journal_rows' ELSE 'goods_movements' END AS resource,
  CAST(ts AS TIMESTAMP) AS last_run_at,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(ts AS TIMESTAMP) END AS watermark_updated_on,
  CASE WHEN event_type = 'click' THEN event_id ELSE NULL END AS watermark_id,
  CASE WHEN event_id % 20 = 0 THEN 'backfill' ELSE 'sweep' END AS last_run_kind,
  user_id AS last_run_rows
FROM {events}
""",
    "erp_legacy_sales": f"""
SELECT CAST(o_orderkey AS STRING) AS source_order_id, CAST(o_orderdate AS DATE) AS order_date,
  o_custkey AS customer_id,
  CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE concat('c', CAST(o_custkey AS STRING), '@example.com') END AS customer_email,
  concat('Company ', CAST(o_custkey % 400 AS STRING)) AS customer_company,
  concat('State ', CAST(o_custkey % 50 AS STRING)) AS ship_state,
  concat('Legacy-', CAST(o_custkey % 4 AS STRING)) AS channel,
  l_partkey AS product_id, concat('SKU-', CAST(l_partkey AS STRING)) AS sku,
  concat('Item ', CAST(l_partkey % 500 AS STRING)) AS product_name, 'YD' AS unit_of_measure,
  CAST(l_quantity AS DECIMAL(18,4)) AS quantity,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS line_net
FROM {{orders}} JOIN {{lineitem}} ON l_orderkey = o_orderkey
WHERE o_orderdate < {CUTOVER}
""",
}

# Names the views use, and the adapter that stands in for each table.
VIEW_TABLES = {
    "orders": "erp_orders",
    "order_rows": "erp_order_rows",
    "channels": "erp_channels",
    "products": "erp_products",
    "contacts": "erp_contacts",
    "product_availability": "erp_availability",
    "warehouses": "erp_warehouses",
    "brands": "erp_brands",
    "nominal_codes": "erp_nominal_codes",
    "product_suppliers": "erp_product_suppliers",
    "journal_rows": "erp_journal_rows",
    "change_events": "erp_change_events",
    "run_log": "erp_run_log",
    "legacy_sales": "erp_legacy_sales",
}


def _base_names(text: str) -> list[str]:
    return sorted(set(re.findall(r"(?<!\{)\{(\w+)\}", text)))


class ErpTables(Mapping[str, DataFrame]):
    """The ERP tables of one data folder; a table is read on first use."""

    def __init__(self, spark: SparkSession, folder: str, **overrides: str):
        self._spark, self._folder = spark, folder
        self._adapters = {**VIEW_TABLES, **overrides}
        self._made: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        key = f"base:{name}"
        if key not in self._made:
            self._made[key] = self._spark.read.parquet(f"{self._folder}/{name}.parquet")
        return self._made[key]

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            text = ADAPTERS[self._adapters[name]]
            frames = {b: self.base(b) for b in _base_names(text)}
            self._made[name] = self._spark.sql(text, **frames)
        return self._made[name]

    def __iter__(self):
        return iter(self._adapters)

    def __len__(self) -> int:
        return len(self._adapters)


def both_eras(spark: SparkSession, folder: str) -> ErpTables:
    """Tables for views that join the eras: current orders start at the cutover."""
    return ErpTables(spark, folder, orders="erp_current_orders")


def adapter_ctes(*names: str) -> str:
    """`name AS (...)` items of a WITH clause for DuckDB."""
    return ",\n".join(
        f"{n} AS ({ADAPTERS[n].format(**{b: b for b in BASE_TABLES})})" for n in names
    )
