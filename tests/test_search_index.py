import random
import re

import pytest
from pyspark.sql import functions as F

from tradelake.functions.predicates import any_column_like
from tradelake.plans.search_index import TextIndex, literals
from tradelake.session import work_folder


@pytest.fixture(scope="module")
def things(spark):
    rng = random.Random(3)
    words = ["Lamp", "lampshade", "ÉTUDE", "50%", "a_b", "back\\slash", "xy", "Zz", "étude in blue", "İx"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 4]))), rng.choice([None, "", "ab", "Lamp post", "été"])) for k in range(300)]
    frame = spark.createDataFrame(rows, "id BIGINT, name STRING, note STRING")
    index = TextIndex(spark, work_folder(spark, "text-index"), "id", buckets=32)
    index.build(frame, frame)
    return frame, index


@pytest.mark.parametrize("term", [
    "lamp", "LAMPSHADE", "mp sh", "l_mp%post", "étude", "Étu%blue", "50\\%", "a\\_b", "xy", "z", "", "%", "a%b", "k\\\\slash", "nothing here", "İx",
])
def test_answers_equal_a_full_scan(things, term):
    frame, index = things
    found = any_column_like(term, "name", "note")
    want = sorted(map(tuple, frame.filter(found).collect()), key=str)
    assert sorted(map(tuple, index.candidates(term).filter(found).collect()), key=str) == want


def test_literals():
    assert literals("ab%c_d\\%e\\\\") == ["ab", "c", "d%e\\"]


def test_only_candidate_rows_are_read(spark):
    rows = spark.range(2000).select("id", F.concat(F.lit("item "), F.hex("id"), F.when(F.col("id") == 77, " needle").otherwise("")).alias("name"))
    index = TextIndex(spark, work_folder(spark, "needle"), "id", buckets=32)
    index.build(rows, rows)
    found = index.candidates("needle")
    assert [r["id"] for r in found.collect()] == [77]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*row_bucket#\d+ = \d+", plan) and "gram_bucket" in plan, plan
    assert spark.read.parquet(index.rows_path).filter("row_bucket = " + re.search(r"row_bucket#\d+ = (\d+)", plan)[1]).count() < 200
