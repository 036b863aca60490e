import pytest
from pyspark.sql import functions as F

from tradelake.functions import predicates as p
from tradelake.functions.money import difference, product

SALES = [
    ("Completed", 28, True), ("Pending - Quote", 99, False), ("PENDING", None, False),
    ("cancelled", 99, False), ("Cancelled order", 99, True), (None, 38, False), (None, 99, True),
    (None, None, True), ("Completed", None, True), ("Renamed", 79, False), ("Renamed", 78, True),
]


@pytest.mark.parametrize("name, status, expected", SALES)
def test_reportable_sale(spark, name, status, expected):
    df = spark.createDataFrame([(name, status)], "order_status_name STRING, order_status_id BIGINT")
    assert df.select(p.reportable_sale()).first()[0] is expected


@pytest.mark.parametrize("name, status, expected", [
    ("Draft PO", 1, False), ("draft", None, False), (None, 6, False), (None, None, True), ("Placed", 7, True),
])
def test_committed_purchase(spark, name, status, expected):
    df = spark.createDataFrame([(name, status)], "order_status_name STRING, order_status_id BIGINT")
    assert df.select(p.committed_purchase()).first()[0] is expected


def test_live(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "is_deleted BOOLEAN")
    assert [r[0] for r in df.select(p.live()).collect()] == [False, True, True]


def test_still_open_drops_unknown(spark):
    df = spark.createDataFrame([("Completed",), ("Placed",), (None,)], "order_status_name STRING")
    assert [r[0] for r in df.filter(p.still_open()).collect()] == ["Placed"]


def test_search_terms(spark):
    df = spark.createDataFrame([("AB-1", None), (None, "x_Yz"), (None, None)], "a STRING, b STRING")
    assert df.filter(p.any_column_like("b-", "a", "b")).count() == 1
    assert df.filter(p.any_column_like("X_y", "a", "b")).count() == 1
    assert df.filter(p.joined_text_like(" x", "a", "b")).count() == 1
    assert df.filter(p.joined_text_like("ab-1 ", "a", "b")).count() == 1
    with pytest.raises(ValueError):
        p.any_column_like("a\\", "a")


def test_money(spark):
    df = spark.sql(
        "SELECT CAST('123456789.123456789' AS DECIMAL(38,9)) AS a, CAST('2.000000001' AS DECIMAL(38,9)) AS b, "
        "CAST('12345678901234567890' AS DECIMAL(38,9)) AS big, CAST(NULL AS DECIMAL(38,9)) AS n"
    )
    from decimal import Decimal
    row = df.select(
        product(F.col("a"), F.col("b")).alias("ab"), product(F.col("big"), F.col("b")).alias("wide"),
        product(F.col("big"), F.col("big")).alias("over"), product(F.col("a"), F.col("n")).alias("null"),
        difference(F.col("a"), product(F.col("a"), F.col("b"))).alias("diff"),
    ).first()
    assert row["ab"] == Decimal("246913578.370370367")
    # exact product 24691357814814814681.23456789; the wide form keeps six digits
    assert row["wide"] == Decimal("24691357814814814681.234568")
    assert row["over"] is None and row["null"] is None
    assert row["diff"] == Decimal("123456789.123456789") - Decimal("246913578.370370367")
