"""Writes to keyed tables, incremental loads and change events.

Each query writes real tables under the shared work folder and returns the end
state, read back.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tradelake.operators import keyed, projections
from tradelake.operators.bucketed import BucketedTable
from tradelake.operators.incremental import Sync
from tradelake.operators.question_log import append_log, read_log
from tradelake.operators.snapshots import replace_snapshot
from tradelake.operators.state import freshness_report, staleness, state_from_runs, status_listing
from tradelake.operators.store import TableStore
from tradelake.plans import questions
from tradelake.plans.views import sales_flat
from tradelake.schemas import LEGACY_SALES, Resource, TableSpec, conform, table_schema
from tradelake.session import side_by_side, work_folder
from tradelake.sources import history_csv
from tradelake.sources.payloads import PayloadArchive
from tradelake.sources.testdata import ErpTables, both_eras
from tradelake.streaming import change_events
from tradelake.suite import payload_queries as payloads, view_queries
from tradelake.suite.common import plain, sql_time, with_adapters

RUN_TIME = datetime(2002, 1, 1)
NOW_TEXT = "2002-01-01 00:00:00"

LINES = TableSpec(
    "lines",
    table_schema("order_row_id BIGINT NOT NULL, order_id BIGINT, product_id BIGINT, quantity DECIMAL(38,9), row_net DECIMAL(38,9), "
                 "when_upserted TIMESTAMP NOT NULL"),
    "order_row_id",
)
TIES = ("product_id", "quantity", "row_net")
BATCH_FROM, BASE_TO, SMALL_FROM = "1998-01-01", "1999-01-01", "2001-10-01"


def _now():
    return F.lit(NOW_TEXT).cast("timestamp")


def _store(spark: SparkSession, purpose: str) -> TableStore:
    store = TableStore(spark, work_folder(spark, purpose))
    store.register(LINES)
    return store


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return ErpTables(spark, d)["order_rows"].select(*LINES.schema.fieldNames())


def _latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return plain(keyed.latest_per_key(_lines(spark, d), "order_row_id", "when_upserted", TIES))


def _order_line_sequence(spark: SparkSession, d: str) -> DataFrame:
    # The day of shipping never decreases along the order of the lines.
    numbered = keyed.running_sequence(
        _lines(spark, d), "order_id",
        ["when_upserted", "order_row_id", *TIES], F.to_date("when_upserted"),
    )
    uid = F.concat_ws("-", "order_id", "seq")
    return plain(numbered.select("order_id", "order_row_id", "when_upserted", *TIES, "seq", uid.alias("line_uid")))


def _upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    store, lines = _store(spark, "upsert-merge"), _lines(spark, d)
    old = keyed.latest_per_key(
        lines.filter(F.col("when_upserted") < F.lit(BASE_TO).cast("timestamp")),
        "order_row_id", "when_upserted", TIES,
    )
    store.truncate_load("lines", old)
    store.upsert("lines", lines.filter(F.col("when_upserted") >= F.lit(BATCH_FROM).cast("timestamp")), TIES)
    return plain(store.read("lines"))


def _bucketed_merge(spark: SparkSession, d: str) -> DataFrame:
    """The same upsert into a table bucketed by its key."""
    lines = _lines(spark, d)
    folder = work_folder(spark, "bucketed")
    table = BucketedTable(spark, f"lines_{folder[-12:]}", folder, "order_row_id")
    old = keyed.latest_per_key(
        lines.filter(F.col("when_upserted") < F.lit(BASE_TO).cast("timestamp")),
        "order_row_id", "when_upserted", TIES,
    )
    table.load(old)
    table.upsert(lines.filter(F.col("when_upserted") >= F.lit(BATCH_FROM).cast("timestamp")), TIES)
    return plain(table.read())


def _upsert_small_batch(spark: SparkSession, d: str) -> DataFrame:
    store, lines = _store(spark, "upsert-small"), _lines(spark, d)
    store.truncate_load("lines", keyed.latest_per_key(lines, "order_row_id", "when_upserted", TIES))
    late = lines.filter(F.col("when_upserted") >= F.lit(SMALL_FROM).cast("timestamp"))
    store.upsert("lines", late.withColumn("row_net", -F.col("row_net")), TIES)
    return plain(store.read("lines"))


def _replace_children(spark: SparkSession, d: str) -> DataFrame:
    store, t = _store(spark, "replace-children"), ErpTables(spark, d)
    store.truncate_load("order_rows", t["order_rows"])
    parents = t["orders"].filter("order_payment_status = 'UNPAID'").select("order_id")
    rows = t["order_rows"].filter("quantity >= 25").join(parents, "order_id", "left_semi")
    store.replace_children("order_rows", parents, rows)
    return plain(
        store.read("order_rows").select("order_row_id", "order_id", "product_id", "quantity", "row_net", "discount_percentage")
    )


def _soft_delete(spark: SparkSession, d: str) -> DataFrame:
    store, orders = _store(spark, "soft-delete"), ErpTables(spark, d)["orders"]
    store.truncate_load("orders", orders)
    store.mark_deleted("orders", orders.filter("order_status_name = 'Cancelled'"), _now())
    return plain(store.read("orders").select("order_id", "order_status_name", "is_deleted", "deleted_at"))


def _contacts(t: ErpTables) -> DataFrame:
    return t["contacts"].withColumn("when_upserted", _now())


def _truncate_load(spark: SparkSession, d: str) -> DataFrame:
    store, contacts = _store(spark, "truncate-load"), _contacts(ErpTables(spark, d))
    store.truncate_load("contacts", contacts)
    store.truncate_load("contacts", contacts.filter("email IS NOT NULL"))
    return plain(store.read("contacts").select("contact_id", "last_name", "email", "telephone", "is_deleted"))


def _additive_columns(spark: SparkSession, d: str) -> DataFrame:
    """A table gains a column: rows written before read NULL there."""
    store, lines = _store(spark, "additive-columns"), _lines(spark, d)
    store.truncate_load("lines", keyed.latest_per_key(lines, "order_row_id", "when_upserted", TIES))
    wider = table_schema("note STRING").fields
    wider = T.StructType([*LINES.schema.fields, *wider])
    store.register(TableSpec("lines", wider, "order_row_id"))
    late = lines.filter(F.col("when_upserted") >= F.lit(SMALL_FROM).cast("timestamp"))
    store.upsert("lines", late.withColumn("note", F.lit("late")), TIES)
    return plain(store.read("lines"))


def _rebucketed_upsert(spark: SparkSession, d: str) -> DataFrame:
    """All keys twice, declared with another bucket count in between."""
    store, lines = _store(spark, "rebucketed"), _lines(spark, d)
    store.upsert("lines", lines.filter(F.col("when_upserted") < F.lit(SMALL_FROM).cast("timestamp")), TIES)
    store.register(replace(LINES, buckets=16))
    store.upsert("lines", lines, TIES)
    return plain(store.read("lines"))


def _limited_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of a limited size, until one has caught up: every order is there."""
    store, orders = _store(spark, "limited"), ErpTables(spark, d)["orders"]
    sync = Sync(store, RUN_TIME)
    limit = orders.count() // 3 + 1
    while sync.by_updated("orders", orders, limit=limit) >= limit:
        pass
    return plain(store.read("orders").select("order_id", "reference", "updated_on"))


def _pages_come_and_go(spark: SparkSession, d: str) -> DataFrame:
    """Two loads of pages, the second of other keys and without one of the columns."""
    store, t = _store(spark, "pages"), ErpTables(spark, d)
    rows = t.base("customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("n"))
    sync = Sync(store, RUN_TIME)
    meta = '{"metaData": {"columns": [{"name": "brandId", "reportDataType": "INTEGER"}%s]}, "results": ['
    name = ', {"name": "brandName", "reportDataType": "STRING"}'
    cells = F.to_json(F.array(F.col("k").cast("string"), "n"))
    pages = rows.groupBy(F.floor(F.col("k") / 50).alias("page"), (F.col("k") % 2).alias("odd"))
    full = pages.agg(F.concat(F.lit(meta % name), F.array_join(F.collect_list(cells), ","), F.lit("]}")).alias("page_text"))
    bare = pages.agg(F.concat(F.lit(meta % ""), F.array_join(F.collect_list(F.concat(F.lit('["'), "k", F.lit('"]'))), ","), F.lit("]}")).alias("page_text"))
    brands = Resource("brands", "search", "brandId", "id", "brandId", "warm")
    sync.pages(brands, full.filter("odd = 0").select(F.col("page_text").alias("page")), full=True)
    sync.pages(brands, bare.filter("odd = 1").select(F.col("page_text").alias("page")), full=True)
    return plain(store.read("brands").select("brand_id", "brand_name"))


def _reference_to_channels(spark: SparkSession, d: str) -> DataFrame:
    """Channels loaded from a reference payload, and the sales view over the loaded table."""
    store, t = _store(spark, "reference"), ErpTables(spark, d)
    Sync(store, RUN_TIME).reference("channels", _channel_payload(t))
    sales = sales_flat({**t, "channels": store.read("channels")})
    return plain(sales)


def _channel_payload(t: ErpTables) -> DataFrame:
    """The channels as one collection payload."""
    items = t["channels"].select(F.to_json(F.struct(F.col("id").alias("id"), F.col("name").alias("name"))).alias("item"))
    return items.agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("item")), ","), F.lit("]")).alias("payload"))


def _stored_sales(group_by: str):
    """A question over loaded tables: orders by two runs, their lines, channels from a payload, the history by month."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        store, t = _store(spark, "stored-sales"), both_eras(spark, d)
        sync = Sync(store, RUN_TIME)
        early = t["orders"].filter(F.col("updated_on") < F.lit("1999-01-01").cast("timestamp"))
        sync.orders(early, t["order_rows"])
        sync.orders(t["orders"], t["order_rows"])
        sync.reference("channels", _channel_payload(t))
        store.publish("legacy_sales", lambda path: history_csv.write_by_month(conform(t["legacy_sales"], LEGACY_SALES), path))
        tables = {name: store.read(name) for name in ("orders", "order_rows", "channels")}
        tables["legacy_sales"] = history_csv.read_by_month(store)
        return plain(questions.query_sales(tables, view_queries.FROM, view_queries.TO, group_by))

    return query


def _reconcile(at_least: int):
    def query(spark: SparkSession, d: str) -> DataFrame:
        store, t = _store(spark, "reconcile"), ErpTables(spark, d)
        store.truncate_load("contacts", _contacts(t))
        source = t.base("customer").filter(F.col("c_acctbal") >= at_least)
        sync = Sync(store, RUN_TIME)
        sync.reconcile("contacts", source.select(F.col("c_custkey").alias("contact_id")))
        return plain(store.read("contacts").select("contact_id", "is_deleted", "deleted_at"))

    return query


NOTICES = TableSpec(
    "notices", table_schema("event_id BIGINT NOT NULL, resource STRING, event STRING, when_upserted TIMESTAMP NOT NULL"),
    "event_id",
)


def _synced_by_id(spark: SparkSession, d: str) -> TableStore:
    store = _store(spark, "incremental-id")
    store.register(NOTICES)
    events = ErpTables(spark, d)["change_events"].withColumn("when_upserted", F.col("ts").cast("timestamp"))
    sync = Sync(store, RUN_TIME)
    early = events.filter(F.col("when_upserted") < F.lit("2024-01-08").cast("timestamp"))
    sync.by_id("notices", early)
    sync.by_id("notices", events.withColumn("event", F.lit("second run")))
    sync.save()
    return store


def _incremental_by_id(spark: SparkSession, d: str) -> DataFrame:
    return plain(_synced_by_id(spark, d).read("notices"))


def _incremental_state(spark: SparkSession, d: str) -> DataFrame:
    return plain(_synced_by_id(spark, d).read("sync_state"))


def _incremental_by_updated(spark: SparkSession, d: str) -> DataFrame:
    store, t = _store(spark, "incremental-updated"), ErpTables(spark, d)
    sync = Sync(store, RUN_TIME)
    orders = t["orders"]
    early = orders.filter(F.col("updated_on") < F.lit("1999-01-01").cast("timestamp"))
    sync.orders(early, t["order_rows"].withColumn("product_name", F.lit("first run")))
    sync.orders(orders.withColumn("reference", F.lit("second run")), t["order_rows"])
    lines = (
        store.read("order_rows").groupBy("order_id")
        .agg(F.count(F.lit(1)).alias("line_count"), F.count_if(F.col("product_name") == "first run").alias("old_lines"))
    )
    return plain(
        store.read("orders").join(lines, "order_id", "left")
        .select("order_id", "reference", "updated_on", F.coalesce("line_count", F.lit(0)).alias("line_count"),
                F.coalesce("old_lines", F.lit(0)).alias("old_lines"))
    )


def _supplier_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """A guarded snapshot load: refused requests are skipped, the rest replaces."""
    store, t = _store(spark, "snapshot"), ErpTables(spark, d)
    refused = F.col("product_id") % 5 == 3
    fetched = payloads.supplier_payloads(t).withColumn("status", F.when(refused, 400).otherwise(200))
    replace_snapshot(
        store, "product_suppliers", fetched,
        lambda raw: projections.supplier_rows(raw, t["products"], _now()),
    )
    return plain(store.read("product_suppliers").drop("when_upserted"))


def _product_id_lists(spark: SparkSession, d: str) -> DataFrame:
    products = ErpTables(spark, d)["products"]
    lists = {
        "all": projections.all_product_ids, "stock_tracked": projections.stock_tracked_ids,
        "live": projections.live_product_ids,
    }
    frames = [ids(products).withColumn("list", F.lit(name)) for name, ids in lists.items()]
    return plain(frames[0].unionByName(frames[1]).unionByName(frames[2]))


# -- events


def _notice_folder(spark: SparkSession, d: str, folder: str) -> str:
    events = ErpTables(spark, d)["change_events"].select("resource", "id", "event")
    events.write.json(f"{folder}/notices")
    return f"{folder}/notices"


def _event_ids_coalesced(spark: SparkSession, d: str) -> DataFrame:
    """The stream's distinct ids per resource, each batch written under its number."""
    folder = work_folder(spark, "events")
    notices = change_events.read_events(spark, _notice_folder(spark, d, folder))

    def write(batch: DataFrame, batch_id: int) -> None:
        ids = change_events.event_ids(batch).select("resource", "id").distinct()
        ids.write.mode("overwrite").parquet(f"{folder}/ids/batch={batch_id}")

    change_events.start(notices, write, f"{folder}/checkpoint", available_now=True).awaitTermination()
    return plain(spark.read.parquet(f"{folder}/ids").select("resource", "id").distinct())


def _event_routing(spark: SparkSession, d: str) -> DataFrame:
    events = ErpTables(spark, d)["change_events"]
    ids = change_events.event_ids(events).withColumn(
        "table_name", change_events.target_table(F.col("resource"))
    )
    return plain(
        ids.groupBy("resource", "table_name", "event")
        .agg(F.count(F.lit(1)).alias("notices"), F.count_distinct("id").alias("ids"))
    )


def _destroyed_soft_delete(spark: SparkSession, d: str) -> DataFrame:
    store, t = _store(spark, "destroyed"), ErpTables(spark, d)
    store.truncate_load("products", t["products"].withColumn("when_upserted", _now()))
    notices = change_events.read_events(spark, _notice_folder(spark, d, store.root))
    apply = change_events.ApplyChanges(store, payloads={}, now=_now())
    store.truncate_load("orders", t["orders"])
    store.truncate_load("contacts", _contacts(t))
    change_events.start(notices, apply, f"{store.root}/_checkpoint", available_now=True).awaitTermination()
    frames = [
        store.read(name).select(F.lit(name).alias("table_name"), F.col(key).alias("id"), "is_deleted", "deleted_at")
        for name, key in (("orders", "order_id"), ("products", "product_id"), ("contacts", "contact_id"))
    ]
    return plain(frames[0].unionByName(frames[1]).unionByName(frames[2]))


def _change_stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Notices turned into current rows of orders, lines, products, stock and contacts."""
    store, t = _store(spark, "changes"), ErpTables(spark, d)
    old = {
        "products": t["products"].withColumn("when_upserted", _now()), "contacts": _contacts(t),
        "orders": t["orders"], "order_rows": t["order_rows"],
    }
    notices = change_events.read_events(spark, _notice_folder(spark, d, store.root))
    current_stock = payloads.availability_payloads(t)
    sources = {"orders": payloads.order_payloads, "products": payloads.product_payloads, "contacts": payloads.contact_payloads}
    archives = {name: PayloadArchive(spark, f"{store.root}/_payloads/{name}") for name in sources}
    side_by_side(
        spark, *[partial(store.truncate_load, name, rows) for name, rows in old.items()],
        *[partial(archive.add, sources[name](t)) for name, archive in archives.items()],
    )
    apply = change_events.ApplyChanges(
        store,
        payloads={name: archive.of for name, archive in archives.items()},
        now=_now(),
        availability=lambda ids: projections.availability_rows(
            current_stock.join(ids, "product_id", "left_semi"), _now()
        ),
    )
    change_events.start(notices, apply, f"{store.root}/_checkpoint", available_now=True).awaitTermination()
    stock = store.read("product_availability").groupBy("product_id").agg(F.sum("on_hand").alias("amount"))
    lines = store.read("order_rows").groupBy("order_id").agg(F.sum("quantity").alias("amount"))
    orders = store.read("orders").join(lines, "order_id", "left").select(
        F.lit("orders").alias("table_name"), F.col("order_id").alias("id"),
        F.col("invoice_reference").alias("label"), "is_deleted", "amount",
    )
    products = store.read("products").join(stock, "product_id", "left").select(
        F.lit("products").alias("table_name"), F.col("product_id").alias("id"),
        F.col("name").alias("label"), "is_deleted", "amount",
    )
    contacts = store.read("contacts").select(
        F.lit("contacts").alias("table_name"), F.col("contact_id").alias("id"),
        F.col("telephone").alias("label"), "is_deleted", F.lit(None).cast("decimal(38,9)").alias("amount"),
    )
    return plain(orders.unionByName(products).unionByName(contacts))


def _batch_delivered_twice(spark: SparkSession, d: str) -> DataFrame:
    """Each batch of notices is delivered twice; what it appends is there once."""
    store, t = _store(spark, "delivered-twice"), ErpTables(spark, d)
    store.truncate_load("contacts", _contacts(t))
    long = F.concat("id", F.lit(","), F.repeat(F.lit("9"), 25))
    broken = t["change_events"].select("resource", F.when(F.col("event_id") % 10 == 0, long).otherwise(F.col("id")).alias("id"), "event")
    broken.repartition(3).write.json(f"{store.root}/notices")
    apply = change_events.ApplyChanges(store, payloads={}, now=_now())

    def twice(batch: DataFrame, batch_id: int) -> None:
        apply(batch, batch_id)
        apply(batch, batch_id)

    notices = change_events.read_events(spark, f"{store.root}/notices", files_per_batch=1)
    change_events.start(notices, twice, f"{store.root}/_checkpoint", available_now=True).awaitTermination()
    tokens = apply.applied.rejected().groupBy("resource", "event", "token").agg(F.count(F.lit(1)).alias("n"))
    applied = apply.applied.read().agg(F.sum("notices").alias("n")).select(
        F.lit("all").alias("resource"), F.lit("applied").alias("event"), F.lit("notices").alias("token"), "n")
    return plain(tokens.unionByName(applied))


def _notices_once(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries that repeat some notices of the one before: each notice is taken once."""
    folder, events = work_folder(spark, "notices-once"), ErpTables(spark, d)["change_events"]
    sent = events.select("event_id", F.col("ts").cast("timestamp").alias("sent_at"), "resource", "id", "event")
    decade = F.floor(F.date_diff(F.to_date("sent_at"), F.lit("2024-01-01").cast("date")) / 10)
    again = F.when(F.col("event_id") % 3 == 0, F.array(decade, decade + 1)).otherwise(F.array(decade))
    delivered = sent.select("*", F.explode(again).alias("delivery"))
    delivered.write.partitionBy("delivery").json(f"{folder}/deliveries")
    more, taken = "event_id BIGINT, sent_at TIMESTAMP", f"{folder}/taken"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{taken}/batch={batch_id}")

    for number in sorted(r[0] for r in delivered.select("delivery").distinct().collect()):  # a few
        arrived = spark.read.schema(f"{change_events.EVENT}, {more}").json(f"{folder}/deliveries/delivery={number}")
        arrived.write.mode("append").json(f"{folder}/inbox")
        inbox = change_events.read_events(spark, f"{folder}/inbox", more=more)
        stream = change_events.once(inbox, "event_id", "sent_at", "30 days")
        change_events.start(stream, write, f"{folder}/checkpoint", available_now=True).awaitTermination()
    rows = spark.read.parquet(taken)
    return plain(rows.groupBy("event_id", "resource").agg(F.count(F.lit(1)).alias("taken")))


def _movements_refreshed(spark: SparkSession, d: str) -> DataFrame:
    """Goods notes among the notices have the movements loaded from their result pages."""
    store, t = _store(spark, "movements"), ErpTables(spark, d)
    sync = Sync(store, RUN_TIME)
    columns = '[{"name":"goodsMovementId","reportDataType":"INTEGER"},{"name":"productId","reportDataType":"INTEGER"},' \
        '{"name":"updatedOn","reportDataType":"DATETIME"}]'
    cells = F.concat(F.lit("["), F.concat_ws(",", "journal_row_id", F.col("journal_row_id") % 1000,
                     F.date_format("journal_date", "'\"'yyyy-MM-dd'T00:00:00Z\"'")), F.lit("]"))
    rows = t["journal_rows"].dropDuplicates(["journal_row_id"])
    pages = rows.groupBy((F.col("journal_row_id") % 997).alias("n")).agg(F.array_join(F.collect_list(cells), ",").alias("r")).select(
        F.concat(F.lit(f'{{"metaData":{{"columns":{columns}}},"results":['), "r", F.lit("]}")).alias("page"))
    notices = change_events.read_events(spark, _notice_folder(spark, d, store.root))
    apply = change_events.ApplyChanges(
        store, payloads={}, now=_now(), refresh_movements=lambda: sync.pages("goods_movements", pages))
    store.truncate_load("orders", t["orders"].limit(0))
    store.truncate_load("products", t["products"].withColumn("when_upserted", _now()).limit(0))
    store.truncate_load("contacts", _contacts(t).limit(0))
    change_events.start(notices, apply, f"{store.root}/_checkpoint", available_now=True).awaitTermination()
    return plain(store.read("goods_movements").select("goods_movement_id", "product_id"))


# -- state

AS_OF = "2024-01-31 00:10:30"


def _run_state_latest(spark: SparkSession, d: str) -> DataFrame:
    return plain(state_from_runs(ErpTables(spark, d)["run_log"], ("run_id",)))


def _state(spark: SparkSession, d: str) -> DataFrame:
    return state_from_runs(ErpTables(spark, d)["run_log"], ("run_id",))


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


def _staleness_check(spark: SparkSession, d: str) -> DataFrame:
    return plain(staleness(_state(spark, d), _as_of()))


def _freshness_report(spark: SparkSession, d: str) -> DataFrame:
    return plain(freshness_report(_state(spark, d), _as_of()))


def _status_listing(spark: SparkSession, d: str) -> DataFrame:
    return plain(status_listing(_state(spark, d)))


def _question_log(spark: SparkSession, d: str) -> DataFrame:
    """Two appends to the log, texts in full."""
    path = work_folder(spark, "question-log")
    log = ErpTables(spark, d)["run_log"].select(
        F.col("last_run_at").alias("called_at"), F.col("resource").alias("tool"),
        F.repeat(F.concat("resource", F.lit(" ")), 300).alias("arguments"),
        (F.col("last_run_kind") == "sweep").alias("ok"),
        F.repeat(F.lit("0123456789"), 60).alias("detail"),
    )
    append_log(log.filter("ok"), path)
    append_log(log.filter("NOT ok"), path)
    return plain(
        read_log(spark, path)
        .select("called_at", "tool", "ok", F.length("arguments").alias("argument_chars"),
                F.length("detail").alias("detail_chars"), "user_email")
    )


QUERIES = {
    "latest_per_key": _latest_per_key,
    "order_line_sequence": _order_line_sequence,
    "upsert_merge": _upsert_merge,
    "bucketed_merge": _bucketed_merge,
    "upsert_small_batch": _upsert_small_batch,
    "replace_children": _replace_children,
    "soft_delete": _soft_delete,
    "truncate_load": _truncate_load,
    "additive_columns": _additive_columns,
    "rebucketed_upsert": _rebucketed_upsert,
    "limited_runs_to_the_end": _limited_runs,
    "pages_column_comes_and_goes": _pages_come_and_go,
    "reference_to_channels": _reference_to_channels,
    "stored_sales_month": _stored_sales("month"),
    "stored_sales_channel": _stored_sales("channel"),
    "reconcile_missing": _reconcile(0),
    "reconcile_refused": _reconcile(5000),
    "incremental_by_id": _incremental_by_id,
    "incremental_state": _incremental_state,
    "incremental_by_updated": _incremental_by_updated,
    "supplier_snapshot": _supplier_snapshot,
    "product_id_lists": _product_id_lists,
    "event_ids_coalesced": _event_ids_coalesced,
    "event_routing": _event_routing,
    "destroyed_soft_delete": _destroyed_soft_delete,
    "change_stream_upsert": _change_stream_upsert,
    "batch_delivered_twice": _batch_delivered_twice,
    "notices_once": _notices_once,
    "movements_refreshed": _movements_refreshed,
    "run_state_latest": _run_state_latest,
    "staleness_check": _staleness_check,
    "freshness_report": _freshness_report,
    "status_listing": _status_listing,
    "question_log": _question_log,
}

_LINE_CTE = """lines AS (
  SELECT order_row_id, order_id, product_id, quantity, row_net, when_upserted FROM erp_order_rows)"""
_NEWEST = """QUALIFY row_number() OVER (PARTITION BY order_row_id
  ORDER BY when_upserted DESC, product_id, quantity, row_net) = 1"""
_PLAIN_LINES = f"""order_row_id, order_id, product_id, CAST(quantity AS DOUBLE) AS quantity,
  CAST(row_net AS DOUBLE) AS row_net, {sql_time("when_upserted")} AS when_upserted"""


def _lines_sql(*ctes: str, select: str) -> str:
    return with_adapters("erp_order_rows", _LINE_CTE, *ctes, select=select)


_IDS = """tokens AS (
  SELECT resource, event, trim(t.token) AS token
  FROM erp_change_events, unnest(string_split(id, ',')) AS t(token)),
ids AS (SELECT resource, event, CAST(token AS BIGINT) AS id FROM tokens WHERE regexp_full_match(token, '[0-9]+'))"""
_ROUTE = """CASE WHEN resource IN ('order', 'sales-order') THEN 'orders' WHEN resource = 'product' THEN 'products'
  WHEN resource = 'contact' THEN 'contacts' WHEN resource IN ('goods-out-note', 'goods-in-note') THEN 'goods_movements' END"""
_STATE = """last_runs AS (
  SELECT * FROM erp_run_log QUALIFY row_number() OVER (PARTITION BY resource ORDER BY last_run_at DESC, run_id) = 1),
state AS (
  SELECT r.resource, (SELECT max(m.watermark_updated_on) FROM erp_run_log m WHERE m.resource = r.resource) AS watermark_updated_on,
    (SELECT max(m.watermark_id) FROM erp_run_log m WHERE m.resource = r.resource) AS watermark_id,
    last_run_at, last_run_kind, last_run_rows FROM last_runs r)"""
_STATE_SQL = with_adapters("erp_run_log", _STATE, select=f"""
SELECT resource, {sql_time("watermark_updated_on")} AS watermark_updated_on, watermark_id,
  {sql_time("last_run_at")} AS last_run_at, last_run_kind, last_run_rows FROM state""")
_BUDGETS = """budgets(resource, budget) AS (
  SELECT unnest(['orders', 'goods_movements']), 30
  UNION ALL SELECT unnest(['contacts', 'journal_rows', 'customer_payments', 'supplier_payments', 'goods_out_notes',
    'companies', 'brands', 'collections', 'product_types', 'seasons', 'categories', 'product_options',
    'product_option_values']), 120
  UNION ALL SELECT unnest(['products', 'contact_groups', 'nominal_codes', 'currencies', 'payment_methods', 'warehouses',
    'shipping_methods', 'warehouse_locations', 'contact_group_members', 'order_statuses', 'order_types',
    'order_stock_statuses', 'order_shipping_statuses', 'tax_codes', 'accounting_periods', 'lead_sources',
    'contact_tags', 'price_lists', 'channel_brands', 'channels']), 3000)"""


def _reconcile_sql(condition: str) -> str:
    return with_adapters("erp_contacts", select=f"""
SELECT c.contact_id, CASE WHEN {condition} THEN TRUE ELSE c.is_deleted END AS is_deleted,
  CASE WHEN {condition} THEN '{NOW_TEXT}' END AS deleted_at
FROM erp_contacts c JOIN customer ON c_custkey = c.contact_id""")


_MERGE_SQL = _lines_sql(
        f"base AS (SELECT * FROM lines WHERE when_upserted < DATE '{BASE_TO}' {_NEWEST})",
        f"batch AS (SELECT * FROM lines WHERE when_upserted >= DATE '{BATCH_FROM}' {_NEWEST})", select=f"""
SELECT {_PLAIN_LINES} FROM (SELECT * FROM batch UNION ALL
  SELECT * FROM base WHERE NOT EXISTS (SELECT 1 FROM batch b WHERE b.order_row_id = base.order_row_id))""")

ORACLES = {
    "latest_per_key": _lines_sql(select=f"SELECT {_PLAIN_LINES} FROM (SELECT * FROM lines {_NEWEST})"),
    "order_line_sequence": _lines_sql(select=f"""
SELECT order_id, order_row_id, {sql_time("when_upserted")} AS when_upserted, product_id,
  CAST(quantity AS DOUBLE) AS quantity, CAST(row_net AS DOUBLE) AS row_net, seq, order_id || '-' || seq AS line_uid
FROM (SELECT *, row_number() OVER (PARTITION BY order_id
  ORDER BY when_upserted, order_row_id, product_id, quantity, row_net) AS seq FROM lines)"""),
    "upsert_merge": _MERGE_SQL,
    "bucketed_merge": _MERGE_SQL,
    "upsert_small_batch": _lines_sql(
        f"base AS (SELECT * FROM lines {_NEWEST})",
        "batch AS (SELECT * FROM (SELECT * REPLACE (-row_net AS row_net) FROM lines "
        f"WHERE when_upserted >= DATE '{SMALL_FROM}') {_NEWEST})", select=f"""
SELECT {_PLAIN_LINES} FROM (SELECT * FROM batch UNION ALL
  SELECT * FROM base WHERE NOT EXISTS (SELECT 1 FROM batch b WHERE b.order_row_id = base.order_row_id))"""),
    "replace_children": with_adapters("erp_orders erp_order_rows", select="""
SELECT r.order_row_id, r.order_id, r.product_id, CAST(r.quantity AS DOUBLE) AS quantity,
  CAST(r.row_net AS DOUBLE) AS row_net, CAST(NULL AS DOUBLE) AS discount_percentage
FROM erp_order_rows r JOIN erp_orders o ON o.order_id = r.order_id
WHERE o.order_payment_status = 'PAID' OR r.quantity >= 25"""),
    "soft_delete": with_adapters("erp_orders", select=f"""
SELECT order_id, order_status_name,
  CASE WHEN order_status_name = 'Cancelled' THEN TRUE ELSE is_deleted END AS is_deleted,
  CASE WHEN order_status_name = 'Cancelled' AND is_deleted IS DISTINCT FROM TRUE THEN '{NOW_TEXT}' END AS deleted_at
FROM erp_orders"""),
    "truncate_load": with_adapters("erp_contacts", select="""
SELECT contact_id, last_name, email, CAST(NULL AS VARCHAR) AS telephone, is_deleted
FROM erp_contacts WHERE email IS NOT NULL"""),
    "additive_columns": _lines_sql(select=f"""
SELECT {_PLAIN_LINES}, CASE WHEN when_upserted >= DATE '{SMALL_FROM}' THEN 'late' END AS note
FROM (SELECT * FROM lines {_NEWEST}) AS newest""".replace("when_upserted >= DATE", "newest.when_upserted >= DATE")),
    "rebucketed_upsert": _lines_sql(select=f"SELECT {_PLAIN_LINES} FROM (SELECT * FROM lines {_NEWEST})"),
    "limited_runs_to_the_end": with_adapters("erp_orders", select=f"""
SELECT order_id, reference, {sql_time("updated_on")} AS updated_on FROM erp_orders"""),
    "pages_column_comes_and_goes": """
SELECT CAST(c_custkey AS BIGINT) AS brand_id, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS brand_name FROM customer""",
    "reference_to_channels": view_queries.ORACLES["sales_flat"],
    "reconcile_missing": _reconcile_sql("c_acctbal < 0 AND c.is_deleted IS DISTINCT FROM TRUE"),
    "reconcile_refused": _reconcile_sql("FALSE"),
    "incremental_by_id": with_adapters("erp_change_events", select=f"""
SELECT event_id, resource, CASE WHEN ts < TIMESTAMP '2024-01-08 00:00:00' THEN event ELSE 'second run' END AS event,
  {sql_time("ts")} AS when_upserted FROM erp_change_events"""),
    "incremental_state": f"""
SELECT 'notices' AS resource, CAST(NULL AS VARCHAR) AS watermark_updated_on, max(event_id) AS watermark_id,
  '{NOW_TEXT}' AS last_run_at, 'id' AS last_run_kind,
  count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-08 00:00:00') AS last_run_rows FROM events""",
    "incremental_by_updated": with_adapters("erp_orders erp_order_rows", """mark AS (
  SELECT max(updated_on) AS m FROM erp_orders WHERE updated_on < DATE '1999-01-01')""",
        """counts AS (SELECT order_id, count(*) AS n FROM erp_order_rows GROUP BY 1)""", select=f"""
SELECT o.order_id, CASE WHEN o.updated_on >= m - INTERVAL 10 MINUTE THEN 'second run' ELSE o.reference END AS reference,
  {sql_time("o.updated_on")} AS updated_on, coalesce(n, 0) AS line_count,
  CASE WHEN o.updated_on >= m - INTERVAL 10 MINUTE THEN 0 ELSE coalesce(n, 0) END AS old_lines
FROM erp_orders o CROSS JOIN mark LEFT JOIN counts c ON c.order_id = o.order_id"""),
    "supplier_snapshot": payloads.ORACLES["supplier_fanout"]
    + " AND s.product_id % 5 <> 3",
    "product_id_lists": with_adapters("erp_products", select="""
SELECT product_id, 'all' AS list FROM erp_products
UNION ALL SELECT product_id, 'stock_tracked' FROM erp_products WHERE stock_tracked
UNION ALL SELECT product_id, 'live' FROM erp_products WHERE is_deleted IS DISTINCT FROM TRUE"""),
    "event_ids_coalesced": with_adapters("erp_change_events", _IDS, select="SELECT DISTINCT resource, id FROM ids"),
    "event_routing": with_adapters("erp_change_events", _IDS, select=f"""
SELECT resource, {_ROUTE} AS table_name, event, count(*) AS notices, count(DISTINCT id) AS ids
FROM ids GROUP BY 1, 2, 3"""),
    "destroyed_soft_delete": with_adapters("erp_change_events erp_orders erp_products erp_contacts", _IDS,
        f"gone AS (SELECT DISTINCT {_ROUTE} AS table_name, id FROM ids WHERE event = 'destroyed')",
        """records AS (SELECT 'orders' AS table_name, order_id AS id, is_deleted FROM erp_orders
  UNION ALL SELECT 'products', product_id, is_deleted FROM erp_products
  UNION ALL SELECT 'contacts', contact_id, is_deleted FROM erp_contacts)""", select=f"""
SELECT r.table_name, r.id, CASE WHEN g.id IS NOT NULL THEN TRUE ELSE is_deleted END AS is_deleted,
  CASE WHEN g.id IS NOT NULL AND is_deleted IS DISTINCT FROM TRUE THEN '{NOW_TEXT}' END AS deleted_at
FROM records r LEFT JOIN gone g ON g.table_name = r.table_name AND g.id = r.id"""),
    "change_stream_upsert": with_adapters(
        "erp_change_events erp_orders erp_order_rows erp_products erp_contacts erp_availability", _IDS,
        f"""notices AS (SELECT {_ROUTE} AS table_name, id, bool_or(event <> 'destroyed') AS changed,
  bool_or(event = 'destroyed') AS gone FROM ids GROUP BY 1, 2)""",
        "line_sums AS (SELECT order_id, sum(quantity) AS amount FROM erp_order_rows GROUP BY 1)",
        "stock_sums AS (SELECT product_id, sum(on_hand) AS amount FROM erp_availability GROUP BY 1)",
        """records AS (
  SELECT 'orders' AS table_name, o.order_id AS id, CAST(NULL AS VARCHAR) AS old_label,
    CASE WHEN order_payment_status = 'PAID' THEN 'SI-' || o.order_id END AS new_label, is_deleted,
    CAST(l.amount AS DOUBLE) AS old_amount, CAST(1 AS DOUBLE) AS new_amount
  FROM erp_orders o LEFT JOIN line_sums l ON l.order_id = o.order_id
  UNION ALL SELECT 'products', p.product_id, name, CASE WHEN status = 'LIVE' THEN 'New ' || name END, is_deleted,
    NULL, CAST(s.amount AS DOUBLE)
  FROM erp_products p LEFT JOIN stock_sums s ON s.product_id = p.product_id
  UNION ALL SELECT 'contacts', contact_id, NULL, '555-' || contact_id, is_deleted, NULL, NULL FROM erp_contacts)""",
        select="""
SELECT r.table_name, r.id, CASE WHEN n.changed THEN new_label ELSE old_label END AS label,
  CASE WHEN n.changed THEN FALSE WHEN n.gone THEN TRUE ELSE is_deleted END AS is_deleted,
  CASE WHEN n.changed THEN new_amount ELSE old_amount END AS amount
FROM records r LEFT JOIN notices n ON n.table_name = r.table_name AND n.id = r.id"""),
    "stored_sales_month": view_queries.ORACLES["query_sales_month"],
    "stored_sales_channel": view_queries.ORACLES["query_sales_channel"],
    "batch_delivered_twice": with_adapters("erp_change_events", """broken AS (
  SELECT resource, event, CASE WHEN event_id % 10 = 0 THEN id || ',' || repeat('9', 25) ELSE id END AS id FROM erp_change_events),
parts AS (SELECT resource, event, trim(t.token) AS token FROM broken, unnest(string_split(id, ',')) AS t(token))""", select="""
SELECT resource, event, token, count(*) AS n FROM parts
WHERE token <> '' AND (NOT regexp_full_match(token, '[0-9]+') OR TRY_CAST(token AS BIGINT) IS NULL) GROUP BY 1, 2, 3
UNION ALL SELECT 'all', 'applied', 'notices', count(*) FROM erp_change_events"""),
    "notices_once": with_adapters("erp_change_events", select="""
SELECT event_id, resource, count(DISTINCT event_id) AS taken FROM erp_change_events GROUP BY 1, 2"""),
    "movements_refreshed": with_adapters("erp_journal_rows", select="""
SELECT DISTINCT journal_row_id AS goods_movement_id, journal_row_id % 1000 AS product_id FROM erp_journal_rows"""),
    "run_state_latest": _STATE_SQL,
    "status_listing": _STATE_SQL,
    "staleness_check": with_adapters("erp_run_log", _STATE, _BUDGETS, f"""lags AS (
  SELECT b.resource, date_sub('minute', s.last_run_at, TIMESTAMP '{AS_OF}') AS lag_minutes,
    CAST(b.budget AS BIGINT) AS budget FROM budgets b LEFT JOIN state s ON s.resource = b.resource)""", select="""
SELECT resource, lag_minutes, budget, CASE WHEN lag_minutes IS NULL THEN 'never synced' ELSE 'stale' END AS problem
FROM lags WHERE lag_minutes IS NULL OR lag_minutes > budget"""),
    "freshness_report": with_adapters("erp_run_log", _STATE, select=f"""
SELECT resource, last_run_kind, last_run_rows,
  strftime(watermark_updated_on, '%Y-%m-%d %H:%M:%S.%f') || '+00' AS watermark,
  strftime(last_run_at, '%Y-%m-%d %H:%M:%S.%f') || '+00' AS last_run_at,
  date_sub('minute', state.last_run_at, TIMESTAMP '{AS_OF}') AS run_lag_minutes FROM state"""),
    "question_log": with_adapters("erp_run_log", select=f"""
SELECT {sql_time("last_run_at")} AS called_at, resource AS tool, last_run_kind = 'sweep' AS ok,
  300 * (length(resource) + 1) AS argument_chars, CAST(600 AS BIGINT) AS detail_chars,
  CAST(NULL AS VARCHAR) AS user_email FROM erp_run_log"""),
}
