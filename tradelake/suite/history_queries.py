"""The CSV history: files written from the legacy adapter, then read back."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from tradelake.operators.store import TableStore
from tradelake.session import work_folder
from tradelake.sources import history_csv
from tradelake.sources.testdata import ErpTables
from tradelake.suite.common import plain, with_adapters

_ORDER = ("source_order_id", "product_id", "quantity", "line_net")


def _now():
    return F.lit("2002-01-01 00:00:00").cast("timestamp")


def _with_thousands(column: str):
    """1234.50 as 1,234.50"""
    return F.format_number(F.col(column), 2)


def write_files(t: ErpTables, path: str, damaged: bool = False, line_breaks: bool = False) -> str:
    """The legacy lines as CSV files: each order in one file, each file in the order of `_ORDER`.

    Some lines have no product, some names hold quotes (and line breaks, if
    asked for), and with `damaged` some cells are broken.
    """
    quantity = F.col("quantity")

    def broken(n: int, value: str, otherwise):
        return F.when((quantity == n) & F.lit(damaged), value).otherwise(otherwise)

    name = F.when(quantity == 2, F.concat("product_name", F.lit(', "wide"' + ("\n" if line_breaks else " ") + "roll"))).otherwise(
        F.col("product_name")
    )
    cells = t["legacy_sales"].select(
        "source_order_id",
        broken(5, "1996/01/02", F.col("order_date").cast("string")).alias("order_date"),
        F.lit("Shipped ").alias("order_status"),
        broken(4, "abc", F.col("customer_id").cast("string")).alias("cust"),
        "customer_email", "customer_company", "ship_state", "channel",
        F.when(quantity == 1, "").otherwise(F.col("product_id").cast("string")).alias("product_id"),
        F.concat(F.lit(" "), "sku").alias("sku"),
        name.alias("product_name"),
        "unit_of_measure",
        broken(6, " ", _with_thousands("quantity")).alias("quantity"),
        broken(3, "#REF!", _with_thousands("line_net")).alias("line_net"),
        F.lit("x").alias("extra"),
        *[F.col(c).alias(f"_{c}") for c in _ORDER],
    )
    order = [f"_{c}" for c in _ORDER]
    # an order lies in one file, so only files need sorting; ranges would make the lines twice
    sorted_files = cells.repartition(order[0]).sortWithinPartitions(*order).drop(*order)
    sorted_files.write.option("header", True).option("escape", '"').csv(path)
    return path


def _records(spark: SparkSession, d: str, damaged: bool, line_breaks: bool = False):
    store = TableStore(spark, work_folder(spark, "history"))
    path = write_files(ErpTables(spark, d), f"{store.root}/files", damaged, line_breaks)
    return store, path


ALIASES = {"cust": "customer_id"}


def _load_report(spark: SparkSession, d: str) -> DataFrame:
    store, path = _records(spark, d, damaged=False)
    return plain(history_csv.load_history(store, path, _now(), ALIASES))


@contextmanager
def _splits(spark: SparkSession, size: str):
    """Files are read in splits of at most this size, so that records cross them at any scale."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _month_partitioned_load(spark: SparkSession, d: str) -> DataFrame:
    store, path = _records(spark, d, damaged=False, line_breaks=True)
    with _splits(spark, "1m"):
        history_csv.load_history(store, path, _now(), ALIASES, quoted_newlines=True)
    rows = history_csv.read_by_month(store)
    return plain(
        rows.select(
            "source_order_id", "source_line_id", "line_uid", "order_date", "order_status",
            "customer_id", "customer_email", "customer_company", "ship_state", "channel",
            "product_id", "sku", "product_name", "unit_of_measure", "quantity", "line_net",
            "order_month", F.get_json_object("raw_payload", "$.extra").alias("extra"),
        )
    )


def _month_pruned_scan(spark: SparkSession, d: str) -> DataFrame:
    """Revenue per month of one year: only that year's folders are read."""
    store, path = _records(spark, d, damaged=False)
    history_csv.load_history(store, path, _now(), ALIASES)
    rows = history_csv.read_by_month(store).filter(
        F.col("order_month").between(F.lit("1996-01-01").cast("date"), F.lit("1996-12-01").cast("date"))
    )
    return plain(
        rows.groupBy("order_month").agg(
            F.sum("line_net").alias("line_net"), F.count(F.lit(1)).alias("line_count")
        )
    )


def _rejects(spark: SparkSession, d: str) -> DataFrame:
    store, path = _records(spark, d, damaged=True)
    # Written once: record numbers then come from one and the same scan.
    parsed = f"{store.root}/parsed"
    history_csv.read_history(spark, path, ALIASES).write.parquet(parsed)
    bad = history_csv.rejects(spark.read.parquet(parsed))
    return plain(bad.groupBy("source_order_id", "problems").agg(F.count(F.lit(1)).alias("records")))


QUERIES = {
    "legacy_load_report": _load_report,
    "month_partitioned_load": _month_partitioned_load,
    "month_pruned_scan": _month_pruned_scan,
    "legacy_rejects": _rejects,
}

ORACLES = {
    "legacy_load_report": with_adapters("erp_legacy_sales", select="""
SELECT count(*) AS rows, count(DISTINCT source_order_id) AS orders,
  CAST(round(sum(line_net), 2) AS DOUBLE) AS total_line_net, CAST(min(order_date) AS VARCHAR) AS min_date,
  CAST(max(order_date) AS VARCHAR) AS max_date, count(*) FILTER (WHERE quantity <> 1) AS product_lines,
  count(*) FILTER (WHERE quantity = 1) AS shipping_lines FROM erp_legacy_sales"""),
    "month_partitioned_load": with_adapters("erp_legacy_sales", select="""
SELECT source_order_id, source_order_id || '-' || n AS source_line_id, source_order_id || '-' || n AS line_uid,
  CAST(order_date AS VARCHAR) AS order_date, 'Shipped' AS order_status, customer_id, customer_email,
  customer_company, ship_state, channel, CASE WHEN quantity <> 1 THEN product_id END AS product_id, sku,
  CASE WHEN quantity = 2 THEN product_name || ', "wide"' || chr(10) || 'roll' ELSE product_name END AS product_name,
  unit_of_measure, CAST(quantity AS DOUBLE) AS quantity, CAST(line_net AS DOUBLE) AS line_net,
  CAST(CAST(date_trunc('month', order_date) AS DATE) AS VARCHAR) AS order_month, 'x' AS extra
FROM (SELECT *, row_number() OVER (PARTITION BY source_order_id ORDER BY product_id, quantity, line_net) AS n
  FROM erp_legacy_sales)"""),
    "month_pruned_scan": with_adapters("erp_legacy_sales", select="""
SELECT CAST(CAST(date_trunc('month', order_date) AS DATE) AS VARCHAR) AS order_month,
  CAST(sum(line_net) AS DOUBLE) AS line_net, count(*) AS line_count
FROM erp_legacy_sales WHERE year(order_date) = 1996 GROUP BY 1"""),
    "legacy_rejects": with_adapters("erp_legacy_sales", select="""
SELECT source_order_id, CASE CAST(quantity AS INT) WHEN 3 THEN 'line_net: spreadsheet error'
    WHEN 4 THEN 'customer_id: no integer' WHEN 5 THEN 'order_date: no day'
    WHEN 6 THEN 'quantity: empty' END AS problems, count(*) AS records
FROM erp_legacy_sales WHERE quantity IN (3, 4, 5, 6) GROUP BY 1, 2"""),
}
