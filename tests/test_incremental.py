import json
from datetime import datetime, timedelta

import random

import pytest
from pyspark.sql import functions as F

from tradelake.operators import incremental
from tradelake.operators.incremental import Sync, changed_since, newer_than, next_changes
from tradelake.operators.state import freshness_report, run_records, save_runs, staleness, state_from_runs
from tradelake.schemas import RESOURCES, SYNC_STATE, TIER_BUDGET_MINUTES, TableSpec, table_schema

NOW = datetime(2024, 5, 1, 12)
ROW = table_schema("row_id BIGINT NOT NULL, name STRING, updated_on TIMESTAMP, when_upserted TIMESTAMP NOT NULL")


@pytest.fixture
def sync(store):
    store.register(TableSpec("rows", ROW, "row_id"))
    return Sync(store, NOW)


def source(spark, *rows):
    return spark.createDataFrame([(i, n, t, NOW) for i, n, t in rows], ROW)


def names(store):
    return {r["row_id"]: r["name"] for r in store.read("rows").collect()}


def test_id_watermark_stops_at_seen_ids(spark, sync):
    assert sync.by_id("rows", source(spark, (99, "a", None), (100, "a", None))) == 2
    assert sync.by_id("rows", source(spark, (99, "b", None), (100, "b", None), (101, "b", None))) == 1
    assert names(sync.store) == {99: "a", 100: "a", 101: "b"}
    state = sync.state("rows")
    assert state["watermark_id"] == 101 and state["last_run_rows"] == 1 and state["last_run_kind"] == "id"


def test_id_watermark_survives_an_empty_run(spark, sync):
    sync.by_id("rows", source(spark, (5, "a", None)))
    assert sync.by_id("rows", source(spark)) == 0
    assert sync.state("rows")["watermark_id"] == 5


def test_full_run_upserts_and_keeps_the_watermark(spark, sync):
    sync.by_id("rows", source(spark, (5, "a", None), (9, "a", None)))
    assert sync.by_id("rows", source(spark, (5, "b", None)), full=True) == 1
    assert names(sync.store) == {5: "b", 9: "a"}
    assert sync.state("rows")["watermark_id"] == 9


def test_updated_watermark_reaches_back(spark, sync):
    t = datetime(2024, 1, 1)
    sync.by_updated("rows", source(spark, (1, "a", t), (2, "a", t - timedelta(hours=1))))
    changed = source(
        spark, (1, "b", t - timedelta(minutes=10)), (2, "b", t - timedelta(minutes=11)),
        (3, "b", t + timedelta(minutes=1)),
    )
    assert sync.by_updated("rows", changed) == 2
    assert names(sync.store) == {1: "b", 2: "a", 3: "b"}
    state = sync.state("rows")
    assert state["watermark_updated_on"] == t + timedelta(minutes=1) and state["last_run_kind"] == "sweep"


def test_watermark_never_moves_back(spark, sync):
    t = datetime(2024, 1, 1)
    sync.by_updated("rows", source(spark, (1, "a", t)))
    sync.by_updated("rows", source(spark, (2, "b", t - timedelta(minutes=5))))
    assert sync.state("rows")["watermark_updated_on"] == t


def test_limited_runs_miss_nothing(spark, sync):
    t = datetime(2024, 1, 1)
    rows = source(spark, *[(i, "a", t + timedelta(hours=i)) for i in (3, 1, 2, 4)])
    assert sync.by_updated("rows", rows, limit=2) == 2
    assert set(names(sync.store)) == {1, 2}
    sync.by_updated("rows", rows)
    assert set(names(sync.store)) == {1, 2, 3, 4}


def test_filters_without_watermark(spark):
    df = source(spark, (1, "a", None), (2, "b", NOW))
    assert changed_since(df, "updated_on", None).count() == 2
    assert newer_than(df, "row_id", None).count() == 2
    assert newer_than(df, "row_id", 1).count() == 1
    assert [r["row_id"] for r in next_changes(df, "updated_on", "row_id", 1, None).collect()] == [1]
    assert next_changes(df, "updated_on", "row_id", 5, (NOW, 2)).count() == 0


def test_reload_replaces(spark, sync):
    sync.reload("rows", source(spark, (1, "a", None)))
    sync.reload("rows", source(spark, (2, "b", None)))
    assert names(sync.store) == {2: "b"}


def contacts(spark, n):
    return spark.range(1, n + 1).select(F.col("id").alias("contact_id"), F.lit(NOW).alias("when_upserted"))


def deleted(store):
    return {r["contact_id"] for r in store.read("contacts").filter("is_deleted").collect()}


@pytest.mark.parametrize("kept, gone", [
    (10, set()), (9, {10}), (8, {9, 10}), (7, None), (0, None),
])
def test_reconcile(spark, sync, kept, gone):
    sync.store.truncate_load("contacts", contacts(spark, 10))
    ids = spark.range(1, kept + 1).select(F.col("id").alias("contact_id"))
    assert sync.reconcile("contacts", ids) == (None if gone is None else len(gone))
    assert deleted(sync.store) == (gone or set())
    assert sync.state("contacts")["last_run_kind"] == ("reconcile refused" if gone is None else "reconcile")


def test_reconcile_counts_live_rows_only(spark, sync, now):
    sync.store.truncate_load("contacts", contacts(spark, 10))
    sync.store.mark_deleted("contacts", contacts(spark, 5), now)
    # five live rows; two missing is more than a fifth of them
    ids = spark.range(8, 11).select(F.col("id").alias("contact_id"))
    assert sync.reconcile("contacts", ids) is None
    ids = spark.range(7, 11).select(F.col("id").alias("contact_id"))
    assert sync.reconcile("contacts", ids) == 1


def page(*ids):
    meta = {"columns": [{"name": "journalRowId", "reportDataType": "INTEGER"},
                        {"name": "updatedOn", "reportDataType": "DATETIME"}]}
    return json.dumps({"metaData": meta, "results": [[i, f"2024-01-{i:02d}T00:00:00Z"] for i in ids]})


def pages(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "page STRING")


def test_pages_by_id(spark, sync):
    assert sync.pages("journal_rows", pages(spark, page(3, 2), page(1))) == 3
    assert sync.pages("journal_rows", pages(spark, page(5, 4, 3), page(2, 1))) == 2
    rows = sync.store.read("journal_rows").collect()
    assert sorted(r["journal_row_id"] for r in rows) == [1, 2, 3, 4, 5]
    assert sync.state("journal_rows")["watermark_id"] == 5


def test_pages_full_and_updated(spark, sync):
    from tradelake.schemas import Resource

    full = Resource("snap", "search", "journalRowId", "full", None, "cold")
    sync.pages(full, pages(spark, page(1, 2)))
    sync.pages(full, pages(spark, page(7)))
    assert [r["journal_row_id"] for r in sync.store.read("snap").collect()] == [7]
    moving = Resource("moving", "search", "journalRowId", "updated", "updatedOn", "hot")
    sync.pages(moving, pages(spark, page(3, 5)))
    assert sync.pages(moving, pages(spark, page(4, 5, 6))) == 2
    assert sync.state("moving")["watermark_updated_on"] == datetime(2024, 1, 6)


def test_orders_and_lines_stay_together(spark, sync):
    def headers(*rows):
        return spark.createDataFrame(
            [(i, t, NOW) for i, t in rows], "order_id BIGINT, updated_on TIMESTAMP, when_upserted TIMESTAMP")

    def lines(*rows):
        return spark.createDataFrame(
            [(i, o, NOW) for i, o in rows], "order_row_id BIGINT, order_id BIGINT, when_upserted TIMESTAMP")

    t = datetime(2024, 1, 1)
    sync.orders(headers((1, t), (2, t - timedelta(days=1))), lines((10, 1), (11, 1), (20, 2)))
    sync.orders(headers((1, t + timedelta(days=1)), (2, t - timedelta(days=1))), lines((10, 1), (21, 2)))
    got = sorted((r["order_id"], r["order_row_id"]) for r in sync.store.read("order_rows").collect())
    assert got == [(1, 10), (2, 20)]


def test_run_records(spark, store):
    one = {"resource": "orders", "last_run_at": NOW, "last_run_kind": "sweep", "watermark_id": 7}
    runs = [one, {"resource": "orders", "last_run_at": NOW, "last_run_rows": 3}, {"resource": "brands", "last_run_at": NOW}]
    assert Sync(store, NOW).state("orders") == {}
    assert save_runs(store) == 0 and not store.exists("sync_state")
    assert save_runs(store, *runs) == 2
    row = Sync(store, NOW).state("orders")
    assert (row["watermark_id"], row["last_run_rows"], row["last_run_kind"]) == (7, 3, "sweep")
    # a later record without a watermark keeps it
    save_runs(store, {"resource": "orders", "last_run_at": NOW + timedelta(hours=1)})
    assert Sync(store, NOW).state("orders")["watermark_id"] == 7
    with pytest.raises(ValueError):
        run_records(spark, {"resource": "orders", "nonsense": 1})


def test_limited_runs_get_through(spark, sync):
    t = datetime(2024, 1, 1)
    rows = source(spark, *((k, "a", t + timedelta(seconds=k)) for k in range(10)))
    counts = []
    for want in (3, 6, 9, 10, 10):
        sync.by_updated("rows", rows, limit=3)
        counts.append(len(names(sync.store)))
    assert counts == [3, 6, 9, 10, 10]
    assert sync.save() == 1


def test_pages_keep_what_they_do_not_mention(spark, sync):
    def text(columns, *rows):
        meta = {"columns": [{"name": n, "reportDataType": k} for n, k in columns]}
        return json.dumps({"metaData": meta, "results": rows})

    both, one = [("journalRowId", "INTEGER"), ("note", "STRING")], [("journalRowId", "INTEGER")]
    sync.store.register(TableSpec("journal_rows", table_schema("journal_row_id BIGINT, when_upserted TIMESTAMP"), "journal_row_id", buckets=64))
    sync.pages("journal_rows", pages(spark, text(both, *([k, "keep"] for k in range(20)))))
    sync.pages("journal_rows", pages(spark, text(one, *([k] for k in range(20, 40)))))
    got = {r["journal_row_id"]: r["note"] for r in sync.store.read("journal_rows").collect()}
    assert got == {k: "keep" if k < 20 else None for k in range(40)}
    assert sync.store.spec("journal_rows").buckets == 64


def test_each_page_has_its_own_names(spark, sync):
    swapped = json.dumps({"metaData": {"columns": [{"name": "updatedOn", "reportDataType": "DATETIME"}, {"name": "journalRowId", "reportDataType": "INTEGER"}]},
                          "results": [["2024-01-09T00:00:00Z", 9]]})
    sync.pages("journal_rows", pages(spark, page(3), swapped))
    got = {r["journal_row_id"]: r["updated_on"].day for r in sync.store.read("journal_rows").collect()}
    assert got == {3: 3, 9: 9}


def test_reference_load(spark, sync):
    payloads = spark.createDataFrame([('[{"id": 4, "name": "Web"}]',)], "payload STRING")
    from tradelake.sources.reference_items import reference_rows

    rows = reference_rows(payloads, F.lit(NOW).cast("timestamp"))
    assert sync.reload("channels", rows) == 1
    assert [r["id"] for r in sync.store.read("channels").collect()] == ["4"]


def state(spark, *rows):
    return spark.createDataFrame([(r, None, None, t, "sweep", 1) for r, t in rows], SYNC_STATE)


def test_staleness(spark):
    now = F.lit(NOW).cast("timestamp")
    minutes = lambda n: NOW - timedelta(minutes=n)
    found = staleness(
        state(spark, ("orders", minutes(30)), ("goods_movements", minutes(31)), ("contacts", None),
              ("other", minutes(9999))), now)
    problems = {r["resource"]: (r["lag_minutes"], r["problem"]) for r in found.collect()}
    assert "orders" not in problems and "other" not in problems
    assert problems["goods_movements"] == (31, "stale")
    assert problems["contacts"] == (None, "never synced") and problems["channels"] == (None, "never synced")
    assert len(problems) == len(RESOURCES) - 1


def test_registry():
    assert len(RESOURCES) == 35 and len({r.name for r in RESOURCES}) == 35
    assert {r.kind: sum(x.kind == r.kind for x in RESOURCES) for r in RESOURCES} == {
        "detail": 3, "search": 21, "reference": 11}
    assert all(r.tier in TIER_BUDGET_MINUTES for r in RESOURCES)


def test_freshness(spark):
    row = freshness_report(state(spark, ("orders", NOW - timedelta(seconds=119))), F.lit(NOW).cast("timestamp")).first()
    assert row["run_lag_minutes"] == 1 and row["watermark"] is None
    assert row["last_run_at"] == "2024-05-01 11:58:01.000000+00"


def test_state_from_runs(spark):
    runs = spark.createDataFrame(
        [("a", NOW, 5, NOW, "sweep", 1, 1), ("a", None, None, NOW + timedelta(hours=1), "sweep", 2, 2)],
        "resource STRING, watermark_updated_on TIMESTAMP, watermark_id BIGINT, last_run_at TIMESTAMP, "
        "last_run_kind STRING, last_run_rows BIGINT, run_id BIGINT")
    row = state_from_runs(runs, ("run_id",)).first()
    assert row["last_run_rows"] == 2 and row["watermark_id"] == 5 and row["watermark_updated_on"] == NOW


@pytest.mark.parametrize("limit", [2, 3, 5])
def test_limited_runs_get_past_rows_without_a_time(spark, sync, limit):
    """More rows without a time than the limit; also in a full run, after a time was known."""
    t = datetime(2024, 1, 1)
    rows = source(spark, *((k, "a", None if k % 3 else t + timedelta(seconds=k)) for k in range(9)))
    for name, full in (("a", False), ("b", True)):
        rows = rows.withColumn("name", F.lit(name))
        counts = [sync.by_updated("rows", rows, limit=limit, full=full)]
        while counts[-1] >= limit:
            counts.append(sync.by_updated("rows", rows, limit=limit))
            assert len(counts) < 9
        assert sum(counts) == 9 and names(sync.store) == dict.fromkeys(range(9), name)


def test_rows_without_a_time_are_found_later(spark, sync):
    def source(*rows):
        return spark.createDataFrame([(i, t, NOW) for i, t in rows], "order_id BIGINT, updated_on TIMESTAMP, when_upserted TIMESTAMP")

    sync.by_updated("orders", source((1, NOW), (2, None)))
    assert sync.by_updated("orders", source((1, NOW), (2, None), (3, None), (4, NOW))) == 3  # 2 is known
    assert sorted(r["order_id"] for r in sync.store.read("orders").collect()) == [1, 2, 3, 4]


def test_id_sets_equal_python_sets(spark):
    from tradelake.operators import id_sets

    rng = random.Random(5)
    spread = [0, 1, -1, 32767, 32768, 32769, 65536, -32768, -32769, 2**40, -(2**40), *(rng.randrange(-10**5, 10**5) for _ in range(300))]
    ours, theirs = set(spread), {i for i in spread if rng.random() < 0.7} | {5, 2**41}
    frames = [spark.createDataFrame([(i,) for s in ((*ids, None, *list(ids)[:9]),) for i in s], "id BIGINT") for ids in (ours, theirs)]
    pages = id_sets.compared(*frames)
    n = pages.agg(*[F.sum(c).alias(c) for c in ("ours", "theirs", "missing")]).first()
    assert (n["ours"], n["theirs"], n["missing"]) == (len(ours), len(theirs), len(ours - theirs))
    assert {r["id"] for r in id_sets.missing(*frames, pages).collect()} == ours - theirs
    plan = pages._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_a_refused_reconcile_joins_nothing(spark, sync, monkeypatch):
    from tradelake.operators import id_sets

    monkeypatch.setattr(id_sets, "missing", lambda *a: pytest.fail("joined"))
    sync.store.truncate_load("contacts", contacts(spark, 10))
    assert sync.reconcile("contacts", contacts(spark, 5).select("contact_id")) is None


def test_a_large_limited_run_is_found_by_counting(spark, monkeypatch):
    """The oldest changes without a sort that gathers them: no task holds all of them."""
    rng = random.Random(5)
    times = [None, datetime(1960, 1, 1), NOW, NOW + timedelta(microseconds=1), NOW + timedelta(days=4000)]
    rows = [(rng.choice([None, -(2**63), -5, 0, 3, 4, 2**40, 2**63 - 1]), n, rng.choice(times)) for n in range(90)]
    df = spark.createDataFrame(rows, "row_id BIGINT, n INT, updated_on TIMESTAMP").repartition(3)
    place = lambda r: (r[1] is not None, r[1] or NOW, r[0] is not None, r[0] or 0)
    for after in (None, (None, 0), (NOW, 3)):
        whole = sorted(((r["row_id"], r["updated_on"]) for r in next_changes(df, "updated_on", "row_id", 90, after).collect()), key=place)
        monkeypatch.setattr(incremental, "SORTED", 0)
        for limit in (1, 2, 17, len(whole) - 1, len(whole), len(whole) + 1):
            found = next_changes(df, "updated_on", "row_id", limit, after)
            assert sorted(((r["row_id"], r["updated_on"]) for r in found.collect()), key=place) == whole[:limit]
            assert "TakeOrdered" not in found._jdf.queryExecution().executedPlan().toString()
        monkeypatch.undo()
