"""Every registered query against its SQL, over whole tables."""

import pytest

import __spark_entry__ as entry
import oracle
from tradelake.suite import registry

FOLDER = oracle.TESTDATA / "sf0.001"
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables here")

# The training-data queries, if they are there, have tests of their own.
QUERIES, ORACLES = ({n: x for n, x in given.items() if n in registry.QUERIES} for given in (entry.queries(), entry.oracle_sql()))


@pytest.fixture(scope="module")
def con():
    return oracle.duck(str(FOLDER))


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql(spark, con, name):
    df = QUERIES[name](spark, str(FOLDER))
    assert oracle.compare(df, con, ORACLES[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["month", "revenue", "quantity", "orders"] and df.count() > 0


@pytest.mark.parametrize("name", [
    "sales_flat", "inventory_position", "customer_summary", "monthly_financials", "query_sales_channel",
    "search_customers", "primary_supplier_flag", "order_line_sequence", "staleness_check",
])
def test_same_result_when_nothing_fits_a_broadcast(spark, con, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = QUERIES[name](spark, str(FOLDER))
        assert oracle.compare(df, con, ORACLES[name]) is None
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
