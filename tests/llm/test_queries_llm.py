"""The registered queries: against their SQL where there is one, and the pipeline stage by stage."""

import brute
import corpus_pipeline
import oracle
import pytest

import __spark_entry__ as entry
from tradelake.llm import queries

FOLDER = str(oracle.TESTDATA / "sf0.001")
pytestmark = pytest.mark.skipif(not (oracle.TESTDATA / "sf0.001").exists(), reason="no test tables here")


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_equals_its_sql(spark, name):
    assert oracle.compare(entry.queries()[name](spark, FOLDER), oracle.duck(FOLDER), queries.ORACLES[name]) is None


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)} and "pipeline" in entry.queries()


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, items = docs.columns, [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()} if k < 4 else docs.collect())
        assert k == 4 or docs.columns == columns
    rules, near, cut, clean, packed = kept
    components = brute.jaccard_components(sorted(rules, key=str))
    assert near == {row for k, row in enumerate(sorted(rules, key=str)) if components[k][1] == row[0] or not components[k][0]}
    assert {i for i, _ in cut} <= {i for i, _ in near}
    assert clean == {(i, t) for i, t in cut if not brute.window_hits(t, items)[1]}
    assert {r.doc_id for r in packed} == {i for i, _ in clean}
