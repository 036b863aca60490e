import uuid

import pytest
from pyspark.sql import functions as F

from tradelake.operators.bucketed import BucketedTable
from tradelake.session import work_folder


@pytest.fixture
def table(spark):
    return BucketedTable(spark, f"t_{uuid.uuid4().hex[:8]}", work_folder(spark, "bucketed"), "id", buckets=4, order_col="at")


def frame(spark, *rows):
    return spark.createDataFrame(rows, "id BIGINT, name STRING, at INT")


def test_upsert(spark, table):
    table.load(frame(spark, (1, "a", 1), (2, "a", 1), (None, "n", 1)))
    table.upsert(frame(spark, (2, "old", 2), (2, "new", 3), (3, "c", 1)))
    table.upsert(frame(spark))
    assert sorted((tuple(r)[:2] for r in table.read().collect()), key=str) == [(1, "a"), (2, "new"), (3, "c"), (None, "n")]


def test_no_old_row_is_shuffled(spark, table):
    table.load(spark.range(2000).select("id", F.lit("a").alias("name"), F.lit(1).alias("at")))
    batch = table._save(spark.range(500, 2500).select("id", F.lit("b").alias("name"), F.lit(2).alias("at")), "batch")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = table.merged(spark.table(batch))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan, plan
        assert df.count() == 2500 and df.filter("name = 'b'").count() == 2000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
