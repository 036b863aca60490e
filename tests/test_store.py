from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tradelake.operators import keyed
from tradelake.operators import projections, store as store_module
from tradelake.operators.question_log import append_log, read_log, short_log
from tradelake.operators.snapshots import MalformedPayload, replace_snapshot, usable_payloads
from tradelake.schemas import TableSpec, table_schema
from tradelake.session import work_folder

THING = table_schema("thing_id BIGINT, name STRING, when_upserted TIMESTAMP NOT NULL")


def at(hour):
    return datetime(2024, 1, 1, hour)


@pytest.fixture
def things(store):
    store.register(TableSpec("things", THING, "thing_id"))
    return store


def frame(spark, *rows):
    return spark.createDataFrame([(k, n, at(h)) for k, n, h in rows], THING)


def content(store, name="things"):
    return sorted(((r["thing_id"], r["name"]) for r in store.read(name).collect()), key=lambda r: (r[0] is None, r))


def files_of(store, name="things"):
    """Data files of each bucket folder."""
    out = {}
    for path in store.read(name).inputFiles():
        out.setdefault(path.rsplit("/", 2)[1], set()).add(path)
    return out


def test_new_table_is_empty(things):
    assert not things.exists("things")
    assert content(things) == []
    assert things.read("things").columns == THING.fieldNames()


def test_upsert_keeps_newest_and_counts_input(spark, things):
    assert things.upsert("things", frame(spark, (1, "old", 1), (1, "new", 2), (2, "b", 1))) == 3
    assert content(things) == [(1, "new"), (2, "b")]
    assert things.upsert("things", frame(spark, (2, "c", 0), (3, "d", 1))) == 2
    assert content(things) == [(1, "new"), (2, "c"), (3, "d")]


def test_upsert_twice_is_once(spark, things):
    batch = frame(spark, (1, "a", 1), (2, "b", 1))
    things.upsert("things", batch)
    once = content(things)
    things.upsert("things", batch)
    assert content(things) == once


def test_empty_upsert_changes_nothing(spark, things):
    things.upsert("things", frame(spark, (1, "a", 1)))
    before = files_of(things)
    assert things.upsert("things", frame(spark)) == 0
    assert files_of(things) == before


def test_null_keys_are_added_each_time(spark, things):
    for _ in range(2):
        things.upsert("things", frame(spark, (None, "x", 1), (None, "x", 1), (1, "a", 1)))
    assert content(things) == [(1, "a"), (None, "x"), (None, "x")]


def test_small_upsert_leaves_other_buckets_alone(spark, things):
    things.truncate_load("things", frame(spark, *[(i, "a", 1) for i in range(200)]))
    before = files_of(things)
    assert len(before) == 8
    things.upsert("things", frame(spark, (7, "b", 2)))
    after = files_of(things)
    assert sum(before[b] != after[b] for b in before) == 1
    assert things.read("things").count() == 200
    assert things.read("things").filter("name = 'b'").count() == 1


def test_required_column(spark, things):
    rows = spark.createDataFrame([(1, "a", None)], "thing_id BIGINT, name STRING, when_upserted TIMESTAMP")
    with pytest.raises(Exception, match="when_upserted must not be NULL"):
        things.upsert("things", rows)
    assert not things.exists("things")


def test_truncate_load_replaces_and_empties(spark, things):
    assert things.truncate_load("things", frame(spark, (1, "a", 1), (2, "b", 1))) == 2
    assert things.truncate_load("things", frame(spark, (3, "c", 1))) == 1
    assert content(things) == [(3, "c")]
    assert things.truncate_load("things", frame(spark)) == 0
    assert content(things) == [] and things.exists("things")


def test_failed_load_keeps_table(spark, things):
    things.truncate_load("things", frame(spark, (1, "a", 1)))
    failing = frame(spark, (2, "b", 1)).withColumn("name", F.raise_error(F.lit("source broke")).cast("string"))
    with pytest.raises(Exception, match="source broke"):
        things.truncate_load("things", failing)
    assert content(things) == [(1, "a")]


def test_a_change_that_fails_keeps_the_table(spark, things):
    things.truncate_load("things", frame(spark, *[(i, "a", 1) for i in range(20)]))
    before = files_of(things)
    failing = frame(spark, (2, "b", 1)).withColumn("name", F.raise_error(F.lit("source broke")).cast("string"))
    with pytest.raises(Exception, match="source broke"):
        things.upsert("things", failing)
    assert files_of(things) == before and len(content(things)) == 20


def test_a_batch_is_measured_while_it_is_written(spark, things):
    with things.staged("things", frame(spark, (1, "a", 1), (7, "b", 3)), high=F.max("thing_id"), time=F.max("when_upserted")) as batch:
        assert batch.measures == {"rows": 2, "high": 7, "time": at(3)}
        assert batch.rows.count() == 2
    with things.staged("things", frame(spark), high=F.max("thing_id")) as batch:
        assert batch.measures == {"rows": 0, "high": None}


def test_rows_are_ranked_only_where_keys_repeat(spark, things, monkeypatch):
    ranked = []
    monkeypatch.setattr(store_module, "latest_per_key", lambda *args: ranked.append(1) or keyed.latest_per_key(*args))
    things.upsert("things", frame(spark, (1, "a", 1), (2, "b", 1), (None, "n", 1)))
    assert not ranked and content(things) == [(1, "a"), (2, "b"), (None, "n")]
    things.upsert("things", frame(spark, (1, "c", 2), (1, "d", 3), (3, "e", 1)))
    assert len(ranked) == 1
    things.upsert("things", frame(spark, (None, "o", 2), (None, "p", 3)))
    assert len(ranked) == 2
    assert content(things) == [(1, "d"), (2, "b"), (3, "e"), (None, "n"), (None, "p")]


def test_narrow_decimals_stay_narrow_until_they_are_written(spark, store):
    schema = table_schema("id BIGINT NOT NULL, net DECIMAL(38,9), tax DECIMAL(38,9), when_upserted TIMESTAMP NOT NULL")
    store.register(TableSpec("amounts", schema, "id"))
    rows = spark.sql("SELECT 1L id, CAST(1.25 AS DECIMAL(18,2)) net, CAST(0.5 AS DECIMAL(38,4)) tax, TIMESTAMP '2024-01-01' when_upserted")
    with store.staged("amounts", rows) as batch:
        kinds = {f.name: f.dataType.simpleString() for f in batch.rows.schema}
        assert (kinds["net"], kinds["tax"]) == ("decimal(18,2)", "decimal(38,9)")
        store.upsert_staged("amounts", batch)
    store.upsert("amounts", rows.withColumn("id", F.lit(2).cast("bigint")))
    assert {f.dataType.simpleString() for f in store.read("amounts").select("net", "tax").schema} == {"decimal(38,9)"}
    assert [(r["id"], str(r["net"]), str(r["tax"])) for r in store.read("amounts").orderBy("id").collect()] == [
        (1, "1.250000000", "0.500000000"), (2, "1.250000000", "0.500000000")]


def test_new_column_reads_null_in_old_rows(spark, things):
    things.upsert("things", frame(spark, (1, "a", 1)))
    wide = table_schema("thing_id BIGINT, name STRING, when_upserted TIMESTAMP NOT NULL, extra BOOLEAN")
    things.register(TableSpec("things", wide, "thing_id"))
    things.upsert("things", frame(spark, (2, "b", 1)).withColumn("extra", F.lit(True)))
    assert {r["thing_id"]: r["extra"] for r in things.read("things").collect()} == {1: None, 2: True}


def test_string_keys(spark, things):
    schema = table_schema("code STRING, name STRING, when_upserted TIMESTAMP NOT NULL")
    things.register(TableSpec("codes", schema, "code"))
    for name in ("one", "two"):
        things.upsert("codes", spark.createDataFrame([("x", name, at(1)), ("y", name, at(1))], schema))
    assert sorted(r["name"] for r in things.read("codes").collect()) == ["two", "two"]


def test_whole_loads_leave_one_folder(spark, things):
    for name in ("a", "b"):
        things.truncate_load("things", frame(spark, *[(i, name, 1) for i in range(50)]))
        things.upsert("things", frame(spark, (1, "c", 2)))
    assert len([f for f in things._fs.listStatus(things.path(f"{things.root}/things")) if f.isDirectory()]) == 1
    assert things.read("things").count() == 50


def lines(spark, *rows):
    return spark.createDataFrame(
        [(i, o, at(1)) for i, o in rows], "order_row_id BIGINT, order_id BIGINT, when_upserted TIMESTAMP"
    )


def parents(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "order_id BIGINT")


def rows_of(store):
    return sorted((r["order_id"], r["order_row_id"]) for r in store.read("order_rows").collect())


def test_replace_children(spark, store):
    store.truncate_load("order_rows", lines(spark, (1, 10), (2, 10), (3, 20), (4, 30)))
    assert store.replace_children("order_rows", parents(spark, 10, 20), lines(spark, (5, 10))) == 1
    assert rows_of(store) == [(10, 5), (30, 4)]
    assert store.replace_children("order_rows", parents(spark, 30), lines(spark)) == 0
    assert rows_of(store) == [(10, 5)]
    assert store.replace_children("order_rows", parents(spark), lines(spark)) == 0
    assert rows_of(store) == [(10, 5)]


def shuffled(frame):
    """Nodes of a frame's plan that move rows between tasks."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") + plan.count("rebalance")


def test_kept_rows_are_not_shuffled(spark, store, monkeypatch):
    """Also beyond the size up to which the planner broadcasts by itself."""
    written, write = [], store._write
    monkeypatch.setattr(store, "_write", lambda spec, folder, rows: written.append(rows) or write(spec, folder, rows))
    store.truncate_load("order_rows", lines(spark, *[(i, i // 3) for i in range(90)]))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        store.replace_children("order_rows", parents(spark, *range(10)), lines(spark, (90, 3)))
        assert shuffled(written[-1]) == 1  # the new rows, by bucket
        assert "BroadcastHashJoin" in written[-1]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert rows_of(store) == [(3, 90), *[(i // 3, i) for i in range(30, 90)]]


def test_many_keys_go_part_by_part(spark, store, monkeypatch):
    monkeypatch.setattr("tradelake.operators.store.KEYS", 4)
    store.truncate_load("order_rows", lines(spark, *[(i, i // 3) for i in range(90)]))
    store.replace_children("order_rows", parents(spark, *range(20), None), lines(spark, (90, 3), (91, 40)))
    kept = [(i // 3, i) for i in range(60, 90)]
    assert rows_of(store) == [(3, 90), *kept, (40, 91)]
    store.upsert("order_rows", lines(spark, *[(i, 50) for i in range(60, 90)]))
    assert rows_of(store) == [(3, 90), (40, 91), *[(50, i) for i in range(60, 90)]]


def test_files_of_many_changes_are_gathered_again(spark, store):
    store.truncate_load("order_rows", lines(spark, (0, 7)))
    for i in range(1, 20):
        store.replace_children("order_rows", parents(spark), lines(spark, (i, 7)))
    assert rows_of(store) == [(7, i) for i in range(20)]
    assert len(store.read("order_rows").inputFiles()) <= 6


def test_replaced_children_are_not_deduplicated(spark, store):
    store.replace_children("order_rows", parents(spark, 1), lines(spark, (5, 1), (5, 1)))
    assert rows_of(store) == [(1, 5), (1, 5)]


def test_upsert_into_a_child_table_moves_rows_between_parents(spark, store):
    store.truncate_load("order_rows", lines(spark, *[(i, i) for i in range(30)]))
    store.upsert("order_rows", lines(spark, (3, 17)))
    assert sorted(r for r in rows_of(store) if r[1] == 3) == [(17, 3)]
    assert len(rows_of(store)) == 30


def test_mark_deleted_keeps_first_time(spark, store):
    rows = spark.createDataFrame(
        [(1, None, None), (2, True, at(1)), (3, False, None)],
        "contact_id BIGINT, is_deleted BOOLEAN, deleted_at TIMESTAMP",
    ).withColumn("when_upserted", F.lit(at(0)))
    store.truncate_load("contacts", rows)
    ids = spark.createDataFrame([(1,), (2,), (2,), (99,)], "contact_id BIGINT")
    assert store.mark_deleted("contacts", ids, F.lit(at(5)).cast("timestamp")) == 4
    got = {r["contact_id"]: (r["is_deleted"], r["deleted_at"]) for r in store.read("contacts").collect()}
    assert got == {1: (True, at(5)), 2: (True, at(1)), 3: (False, None)}
    # a record that comes back is live again
    back = spark.createDataFrame([(1,)], "contact_id BIGINT").withColumn("when_upserted", F.lit(at(6))).withColumn("is_deleted", F.lit(False))
    store.upsert("contacts", back)
    row = store.read("contacts").filter("contact_id = 1").first()
    assert row["is_deleted"] is False and row["deleted_at"] is None


def fetched(spark, *rows):
    return spark.createDataFrame(list(rows), "raw_payload STRING, status INT")


PRODUCTS = "product_id BIGINT, raw_payload STRING, is_deleted BOOLEAN"


@pytest.fixture
def suppliers(spark, store, now):
    products = spark.createDataFrame([], PRODUCTS)

    def load(*rows):
        return replace_snapshot(
            store, "product_suppliers", fetched(spark, *rows),
            lambda raw: projections.supplier_rows(raw, products, now),
        )

    return load


def supplier_pairs(store):
    return sorted((r[0], r[1]) for r in store.read("product_suppliers").collect())


def test_snapshot_load_and_rejects(suppliers, store):
    count, rejects = suppliers(('{"1": [10, 20]}', 200), (None, 400), (None, None), ("null", 200))
    assert count == 2 and rejects.count() == 1
    assert supplier_pairs(store) == [(1, 10), (1, 20)]


@pytest.mark.parametrize("bad", [('["x"]', 200), ("5", 200), ("not json", 200), ("{}", 503), (None, 500)])
def test_bad_snapshot_keeps_the_old_one(suppliers, store, bad):
    suppliers(('{"1": [10]}', 200))
    with pytest.raises(MalformedPayload):
        suppliers(('{"2": [20]}', 200), bad)
    assert supplier_pairs(store) == [(1, 10)]


def test_valid_empty_snapshot_empties(suppliers, store):
    suppliers(('{"1": [10]}', 200))
    assert suppliers(("{}", 200))[0] == 0
    assert supplier_pairs(store) == []


def test_usable_payloads_splits(spark):
    usable, rejects = usable_payloads(fetched(spark, ("{}", None), ("{}", 400)))
    assert (usable.count(), rejects.count()) == (1, 1)


def test_question_log(spark):
    path = work_folder(spark, "log")
    entry = spark.createDataFrame([(at(1), "ask", "a" * 3000, True, "d" * 900)],
                                  "called_at TIMESTAMP, tool STRING, arguments STRING, ok BOOLEAN, detail STRING")
    append_log(entry, path)
    append_log(entry, path)
    rows = read_log(spark, path).collect()
    assert len(rows) == 2
    assert len(rows[0]["arguments"]) == 3000 and len(rows[0]["detail"]) == 900
    short = short_log(read_log(spark, path)).first()
    assert (len(short["arguments"]), short["argument_chars"], len(short["detail"])) == (2000, 3000, 500)
    assert rows[0]["user_email"] is None


ROWS = st.lists(
    st.tuples(st.integers(0, 4) | st.none(), st.text("ab", max_size=2), st.integers(0, 3)), max_size=25
)


@settings(max_examples=10, deadline=None)
@given(ROWS, st.randoms())
def test_latest_per_key_does_not_depend_on_row_order(spark, rows, random):
    shuffled = list(rows)
    random.shuffle(shuffled)

    def newest(data):
        df = keyed.latest_per_key(frame(spark, *data), "thing_id", "when_upserted", ("name",))
        return sorted(map(tuple, df.collect()), key=str)

    expected = {}
    for key, name, hour in rows:
        best = expected.get(key)
        if best is None or (-hour, name) < (-best[2], best[1]):
            expected[key] = (key, name, hour)
    assert newest(rows) == newest(shuffled) == sorted(
        ((k, n, at(h)) for k, n, h in expected.values()), key=str
    )


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2) | st.none(), st.integers(0, 50)), max_size=40))
def test_running_sequence(spark, pairs):
    rows = [(k, v, i) for i, (k, v) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "k BIGINT, v BIGINT, i BIGINT")
    got = keyed.running_sequence(df, "k", ["v", "i"], F.floor(F.col("v") / 10))
    seen, expected = {}, []
    for k, v, i in sorted(rows, key=lambda r: (r[1], r[2])):
        seen[k] = seen.get(k, 0) + 1
        expected.append((k, v, i, seen[k]))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)


def test_running_sequence_plan_splits_a_hot_key(spark):
    """All rows of one key: the numbering window is partitioned by chunk too."""
    df = spark.range(1000).select(F.floor(F.col("id") / 5000).alias("k"), "id")
    got = keyed.running_sequence(df, "k", ["id"], F.floor(F.col("id") / 100))
    assert [r["seq"] for r in got.orderBy("id").collect()] == list(range(1, 1001))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan and "_chunk" in plan


def test_other_bucket_counts_do_not_double_keys(spark, things):
    rows = lambda name, n: frame(spark, *[(i, name, n) for i in range(50)])
    things.upsert("things", rows("a", 1))
    things.register(TableSpec("things", THING, "thing_id", buckets=16))
    things.upsert("things", rows("b", 2))
    assert content(things) == [(i, "b") for i in range(50)]
    things.truncate_load("things", rows("c", 3))
    assert things.spec("things").buckets == 16 and len(content(things)) == 50


def test_a_load_cut_short_leaves_the_old_table(spark, things):
    things.truncate_load("things", frame(spark, (1, "a", 1)))
    frame(spark, (9, "z", 1)).write.parquet(f"{things.root}/things/d-cut")
    things._fs.create(things.path(f"{things.root}/things/_cut.draft"), False).close()
    assert content(things) == [(1, "a")]
    things.upsert("things", frame(spark, (2, "b", 1)))
    assert content(things) == [(1, "a"), (2, "b")]


def test_keys_that_repeat_are_not_upserted(spark, store):
    prices = store.read("product_prices")
    with pytest.raises(ValueError, match="does not tell rows apart"):
        store.upsert("product_prices", prices)
