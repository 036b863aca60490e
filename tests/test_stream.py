import json
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tradelake.sources.payloads import PayloadArchive
from tradelake.streaming import change_events as c

NOW = datetime(2024, 5, 1)


@pytest.fixture
def notices(tmp_path):
    folder = tmp_path / "notices"
    folder.mkdir()

    def write(name, *rows):
        (folder / f"{name}.json").write_text(
            "\n".join(json.dumps({"resource": r, "id": i, "event": e}) for r, i, e in rows)
        )
        return str(folder)

    return write


def payload_frame(spark, *rows):
    return spark.createDataFrame([(i, json.dumps(p)) for i, p in rows], "id BIGINT, raw_payload STRING")


def current(frame):
    """The records of a frame by id."""
    return lambda ids: frame.join(ids, "id", "left_semi")


def order(i, ref, *rows):
    return i, {"id": i, "reference": ref, "orderRows": {str(r): {"productId": r} for r in rows}}


def test_event_ids(spark):
    df = spark.createDataFrame(
        [("order", "1, 20,x,3a,,04", "modified"), ("order", "abc", "modified"), ("order", None, "m")], c.EVENT)
    assert [r["id"] for r in c.event_ids(df).collect()] == [1, 20, 4]


def test_routing(spark):
    names = ["order", "sales-order", "product", "contact", "goods-out-note", "goods-in-note", "other"]
    df = spark.createDataFrame([(n,) for n in names], "r STRING")
    got = [r[0] for r in df.select(c.target_table(F.col("r"))).collect()]
    assert got == ["orders", "orders", "products", "contacts", "goods_movements", "goods_movements", None]


def test_burst_is_one_refresh(spark):
    df = spark.createDataFrame(
        [("order", "1", "modified"), ("sales-order", "1", "created"), ("order", "1,2", "modified"),
         ("order", "1", "destroyed"), ("stock", "9", "modified")], c.EVENT)
    got = {tuple(r) for r in c.coalesced(df).collect()}
    assert got == {("orders", False, 1), ("orders", False, 2), ("orders", True, 1)}


def run(spark, store, folder, apply):
    query = c.start(c.read_events(spark, folder), apply, f"{store.root}/_checkpoint", available_now=True)
    query.awaitTermination()


def test_stream_applies_and_restarts(spark, store, notices):
    now = F.lit(NOW).cast("timestamp")
    source = {"frame": payload_frame(spark, order(1, "first", 11, 12), order(2, "two", 21))}
    batches = []
    apply = c.ApplyChanges(store, {"orders": lambda ids: current(source["frame"])(ids)}, now)

    def counted(batch, batch_id):
        batches.append(batch_id)
        apply(batch, batch_id)

    folder = notices("a", ("order", "1,2", "modified"), ("order", "404", "modified"))
    run(spark, store, folder, counted)
    assert {r["order_id"]: r["reference"] for r in store.read("orders").collect()} == {1: "first", 2: "two"}
    assert store.read("order_rows").count() == 3

    # a restart without news does nothing; with news it takes only the new file
    run(spark, store, folder, counted)
    assert batches == [0]
    source["frame"] = payload_frame(spark, order(1, "second", 12), order(2, "not asked for", 21))
    notices("b", ("order", "1", "modified"), ("order", "2", "destroyed"))
    run(spark, store, folder, counted)
    assert batches == [0, 1]
    rows = {r["order_id"]: r for r in store.read("orders").collect()}
    assert rows[1]["reference"] == "second" and rows[2]["reference"] == "two"
    assert rows[2]["is_deleted"] is True and rows[2]["deleted_at"] == NOW
    lines = sorted((r["order_id"], r["order_row_id"]) for r in store.read("order_rows").collect())
    assert lines == [(1, 12), (2, 21)]


def test_redelivered_batch_changes_nothing(spark, store):
    apply = c.ApplyChanges(
        store, {"orders": current(payload_frame(spark, order(1, "a", 11)))}, F.lit(NOW).cast("timestamp"))
    batch = spark.createDataFrame([("order", "1", "modified")], c.EVENT)
    apply(batch, 0)
    first = sorted(map(str, store.read("orders").collect())), store.read("order_rows").collect()
    apply(batch, 0)
    assert (sorted(map(str, store.read("orders").collect())), store.read("order_rows").collect()) == first


def test_surviving_record_beats_its_destruction(spark, store):
    apply = c.ApplyChanges(store, {"orders": current(payload_frame(spark, order(1, "a")))})
    apply(spark.createDataFrame([("order", "1", "modified"), ("order", "1", "destroyed")], c.EVENT), 0)
    assert store.read("orders").first()["is_deleted"] is False


def test_movements_and_stock(spark, store):
    refreshed = []
    stock = spark.createDataFrame([(5, 1, NOW), (6, 1, NOW)], "product_id BIGINT, warehouse_id BIGINT, when_upserted TIMESTAMP")
    store.truncate_load("product_availability", stock.withColumn("on_hand", F.lit(1)))
    apply = c.ApplyChanges(
        store, {"products": current(payload_frame(spark, (5, {"id": 5, "status": "LIVE"})))},
        refresh_movements=lambda: refreshed.append(1),
        availability=lambda ids: stock.join(ids, "product_id", "left_semi").withColumn("on_hand", F.lit(9)),
    )
    events = [("goods-out-note", "7,8", "created"), ("goods-in-note", "7", "created"), ("product", "5", "modified"),
              ("unknown", "1", "modified")]
    apply(spark.createDataFrame(events, c.EVENT), 0)
    assert refreshed == [1]
    got = {r["product_id"]: int(r["on_hand"]) for r in store.read("product_availability").collect()}
    assert got == {5: 9, 6: 1}
    # a destroyed note is no reason to refresh
    apply(spark.createDataFrame([("goods-out-note", "7", "destroyed")], c.EVENT), 1)
    assert refreshed == [1]


def test_a_batch_is_applied_once(spark, store):
    asked = []
    frame = payload_frame(spark, order(1, "a", 11))

    def source(ids):
        asked.append(1)
        return current(frame)(ids)

    apply = c.ApplyChanges(store, {"orders": source}, F.lit(NOW).cast("timestamp"))
    batch = spark.createDataFrame([("order", "1,x,99999999999999999999", "modified")], c.EVENT)
    for batch_id in (0, 0, 1):
        apply(batch, batch_id)
    assert len(asked) == 2
    assert sorted((r["batch"], r["notices"]) for r in apply.applied.read().collect()) == [(0, 1), (1, 1)]
    assert sorted((r["batch"], r["token"]) for r in apply.applied.rejected().collect()) == [
        (0, "99999999999999999999"), (0, "x"), (1, "99999999999999999999"), (1, "x")]


def test_a_batch_cut_short_runs_again(spark, store):
    broken = [True]

    def source(ids):
        if broken:
            raise RuntimeError("source away")
        return current(payload_frame(spark, order(1, "a", 11)))(ids)

    apply = c.ApplyChanges(store, {"orders": source}, F.lit(NOW).cast("timestamp"))
    batch = spark.createDataFrame([("order", "1,x", "modified")], c.EVENT)
    with pytest.raises(RuntimeError, match="source away"):
        apply(batch, 0)
    broken.clear()
    apply(batch, 0)
    assert store.read("orders").first()["reference"] == "a"
    assert apply.applied.rejected().count() == 1


def test_only_buckets_of_the_batch_are_read(spark, store, tmp_path):
    archive = PayloadArchive(spark, str(tmp_path / "orders"), buckets=8)
    archive.add(payload_frame(spark, *[order(i, f"r{i}", 10 * i) for i in range(200)]))
    found = archive.of(spark.createDataFrame([(7,), (7,), (999,)], "id BIGINT").distinct())
    assert [r["id"] for r in found.collect()] == [7]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[bucket#\d+ (IN|=)", plan), plan
    apply = c.ApplyChanges(store, {"orders": archive.of}, F.lit(NOW).cast("timestamp"))
    apply(spark.createDataFrame([("order", "7,8", "modified")], c.EVENT), 0)
    assert sorted((r["order_id"], r["reference"]) for r in store.read("orders").collect()) == [(7, "r7"), (8, "r8")]
    assert store.read("order_rows").count() == 2


def test_an_archive_shuffles_texts_only(spark, tmp_path, monkeypatch):
    kind, moved = type(spark.range(1)), []
    hint = kind.hint
    monkeypatch.setattr(kind, "hint", lambda self, *args: moved.append(self.columns) or hint(self, *args))
    archive = PayloadArchive(spark, str(tmp_path / "orders"), buckets=2)
    archive.add(payload_frame(spark, order(7, "r7", 1)))
    assert moved == [["id", "raw_payload", "bucket"]]
    found = archive.of(spark.createDataFrame([(7,)], "id BIGINT")).selectExpr("to_json(payload) AS p")
    assert [json.loads(r["p"])["reference"] for r in found.collect()] == ["r7"]


def test_a_repeated_notice_of_a_later_batch_is_dropped(spark, tmp_path):
    inbox, taken = tmp_path / "inbox", []
    inbox.mkdir()

    def send(name, *rows):
        (inbox / name).write_text("\n".join(
            json.dumps({"resource": "order", "id": i, "event": "modified", "n": n, "at": at}) for n, i, at in rows))
        stream = c.once(c.read_events(spark, str(inbox), more="n BIGINT, at TIMESTAMP"), "n", "at", "1 hour")
        c.start(stream, lambda b, _: taken.append(sorted(r["n"] for r in b.collect())), str(tmp_path / "checkpoint"), True).awaitTermination()

    send("a.json", (1, "5", "2024-01-01T10:00:00Z"), (2, "6", "2024-01-01T10:01:00Z"), (1, "5", "2024-01-01T10:00:00Z"))
    send("b.json", (2, "6", "2024-01-01T10:01:00Z"), (3, "6", "2024-01-01T10:30:00Z"))
    assert [t for t in taken if t] == [[1, 2], [3]]


def test_the_processing_time_trigger_gathers(spark, store, notices):
    folder = notices("a", ("order", "1", "modified"))
    seen = []
    query = c.start(c.read_events(spark, folder), lambda b, i: seen.append(sorted(r["id"] for r in b.collect())), f"{store.root}/_ck")
    try:
        query.processAllAvailable()
        notices("b", ("order", "2", "modified"))
        notices("c", ("order", "3", "modified"))
        query.processAllAvailable()
    finally:
        query.stop()
    assert seen == [["1"], ["2", "3"]]
