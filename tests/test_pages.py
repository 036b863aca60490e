import json
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import types as T

from tradelake.functions.coerce import snake_case
from tradelake.sources.pages import page_columns, page_rows, table_schema_for
from tradelake.sources.reference_items import reference_rows

COLUMNS = [("rowId", "INTEGER"), ("tagIds", "IDSET"), ("net", "MONEY"), ("isOn", "BOOLEAN"),
           ("changedOn", "DATETIME"), ("label", "STRING"), ("odd", "NEWTYPE")]


def page(*rows, columns=COLUMNS):
    meta = {"columns": [{"name": n, "reportDataType": t} for n, t in columns], "resultsAvailable": len(rows)}
    return json.dumps({"metaData": meta, "results": list(rows)})


def frame(spark, *pages):
    return spark.createDataFrame([(p,) for p in pages], "page STRING")


def test_schema_from_metadata(spark):
    pages = frame(spark, page())
    assert page_columns(pages) == sorted(COLUMNS)
    schema = table_schema_for(COLUMNS)
    assert [f.name for f in schema] == ["row_id", "tag_ids", "net", "is_on", "changed_on", "label", "odd", "when_upserted"]
    assert schema["net"].dataType == T.DecimalType(38, 9)
    assert schema["odd"].dataType == T.StringType()
    assert not schema["when_upserted"].nullable


def test_cells(spark, now):
    pages = frame(
        spark,
        page(["1", [8], "10.123456789", " YES ", "2023-01-01T12:00-05:00", {"a": [1]}, 7, "extra"],
             [2, [8, 9], 0.1, "no", "", None, ""], [3]),
        page([4, 5, None, True, None, "x", None], [5, [], "", 0, None, True, None]),
    )
    rows = {r["row_id"]: r for r in page_rows(pages, COLUMNS, now).collect()}
    assert rows[1]["tag_ids"] == 8 and rows[1]["net"] == Decimal("10.123456789")
    assert rows[1]["is_on"] is True and rows[1]["changed_on"] == datetime(2023, 1, 1, 17)
    assert json.loads(rows[1]["label"]) == {"a": [1]} and rows[1]["odd"] == "7"
    assert rows[2]["tag_ids"] is None and rows[2]["net"] == Decimal("0.1")
    assert rows[2]["is_on"] is False and rows[2]["changed_on"] is None and rows[2]["odd"] is None
    assert rows[3]["label"] is None and rows[3]["is_on"] is None
    assert rows[4]["tag_ids"] == 5 and rows[4]["is_on"] is True
    assert rows[5]["tag_ids"] is None and rows[5]["net"] is None and rows[5]["is_on"] is False
    assert rows[5]["label"] == "true"


def test_last_duplicate_column_wins(spark, now):
    columns = [("rowId", "INTEGER"), ("name", "STRING"), ("name", "STRING")]
    rows = page_rows(frame(spark, page([1, "first", "second"], columns=columns)), columns, now).collect()
    assert rows[0]["name"] == "second"


def test_bad_cell_is_an_error(spark, now):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        page_rows(frame(spark, page(["x1"])), COLUMNS, now).collect()


@pytest.mark.parametrize("name, expected", [
    ("journalRowId", "journal_row_id"), ("id", "id"), ("Name", "name"), ("productSKU", "product_s_k_u"),
    ("tax2Code", "tax2_code"),
])
def test_snake_case(spark, name, expected):
    assert snake_case(name) == expected


def items(spark, now, *payloads):
    df = spark.createDataFrame([(json.dumps(p),) for p in payloads], "payload STRING")
    return [(r["id"], r["name"]) for r in reference_rows(df, now).collect()]


def test_own_id_beats_foreign_keys(spark, now):
    assert items(spark, now, {"aaBrandId": 1, "id": 9, "name": "N"}) == [("9", "N")]


def test_id_by_suffix(spark, now):
    assert items(spark, now, {"tagColor": "red", "tagId": 4, "tagName": "T", "tagParentId": 1}) == [("4", "T")]
    assert items(spark, now, {"zoneParentId": 1, "zzId": 2}) == [("2", None)]
    assert items(spark, now, {"label": "x"}) == [(None, None)]


def test_document_order_counts(spark, now):
    assert items(spark, now, {"zId": 1, "aId": 2, "zName": "z", "aName": "a"}) == [("1", "z")]


def test_name_objects(spark, now):
    assert items(spark, now, {"id": 1, "code": "C", "name": {"text": "T"}}) == [("1", "C")]
    assert items(spark, now, {"id": 1, "name": {"text": "T"}}) == [("1", "T")]
    assert items(spark, now, {"id": 1, "name": "", "title": "Ti"}) == [("1", "Ti")]
    assert items(spark, now, {"id": 1, "name": 5, "description": "D"}) == [("1", "D")]


def test_shapes(spark, now):
    assert items(spark, now, [{"id": 1, "name": "a"}, "junk", 3, None, {"id": 2, "name": "b"}]) == [("1", "a"), ("2", "b")]
    assert items(spark, now, {"1": {"id": 1, "name": "a"}, "20": {"id": 20, "name": "b"}}) == [("1", "a"), ("20", "b")]
    assert items(spark, now, {"1": {"id": 1}, "2": "text", "id": 7}) == [("7", None)]
    assert items(spark, now, None) == [] and items(spark, now, []) == [] and items(spark, now, 5) == []
    assert items(spark, now, {}) == [(None, None)]


def test_columns_are_made_in_steps(spark, now):
    """One projection of many typed cells is too long a method for the JVM to compile."""
    rows = page_rows(frame(spark, page([1])), COLUMNS, now)
    steps = str(rows._jdf.queryExecution().optimizedPlan()).count("Generate explode(")
    assert steps >= 3  # rows, cells, texts
    assert rows.first()["row_id"] == 1
