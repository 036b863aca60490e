"""Change notices as a stream: ids in, current rows out."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tradelake.functions.coerce import trimmed
from tradelake.operators.projections import contact_rows, order_headers, order_lines, product_rows
from tradelake.operators.store import TableStore
from tradelake.session import side_by_side

EVENT = "resource STRING, id STRING, event STRING"
DESTROYED = "destroyed"

# The table an event's resource refreshes, and the resources that
# refresh the goods movements instead.
ROUTES = {
    "order": "orders",
    "sales-order": "orders",
    "product": "products",
    "contact": "contacts",
}
MOVEMENT_TRIGGERS = ("goods-out-note", "goods-in-note")
MOVEMENTS = "goods_movements"

# Fixed value: how long a burst of notices gathers.
COALESCE_WINDOW = "10 seconds"


def read_events(
    spark: SparkSession, folder: str, files_per_batch: int | None = None, more: str = ""
) -> DataFrame:
    """A folder of JSON notices as a stream; `more` names further fields they carry."""
    reader = spark.readStream.schema(", ".join(filter(None, (EVENT, more))))
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(folder)


def once(notices: DataFrame, notice: str, sent_at: str, within: str) -> DataFrame:
    """A stream without the notices that are delivered again, also in a later batch.

    `notice` tells notices apart; `within` bounds how long after `sent_at` one
    may come, or come again. State is kept for that long and no longer.
    """
    return notices.withWatermark(sent_at, within).dropDuplicatesWithinWatermark([notice])


def event_ids(events: DataFrame) -> DataFrame:
    """One row per id of a notice; tokens that are no ids are not among them (see `rejected_ids`)."""
    return _tokens(events).filter(F.col("id").isNotNull()).drop("token")


def rejected_ids(events: DataFrame) -> DataFrame:
    """Tokens that no id can be, as (resource, event, token)."""
    return _tokens(events).filter(F.col("id").isNull()).drop("id")


def _tokens(events: DataFrame) -> DataFrame:
    tokens = F.filter(F.transform(F.split("id", ","), trimmed), lambda t: t != "")
    digits = F.when(F.col("token").rlike("^[0-9]+$"), F.col("token"))
    return events.select("resource", "event", F.explode(tokens).alias("token")).withColumn(
        "id", digits.try_cast("bigint"))


def target_table(resource: Column) -> Column:
    """The table a resource refreshes; NULL for resources to ignore."""
    table = F.when(resource.isin(*MOVEMENT_TRIGGERS), F.lit(MOVEMENTS))
    for name, target in ROUTES.items():
        table = table.when(resource == name, F.lit(target))
    return table


def coalesced(events: DataFrame) -> DataFrame:
    """Distinct (table, destroyed, id) of a batch of notices."""
    return (
        event_ids(events)
        .select(
            target_table(F.col("resource")).alias("table_name"),
            (F.col("event") == DESTROYED).alias("destroyed"),
            "id",
        )
        .filter(F.col("table_name").isNotNull())
        .distinct()
    )


class AppliedBatches:
    """The batches of a stream that are in the tables, and the tokens they rejected.

    A batch is entered last, so one that was cut short is not there and runs
    again; what it appends lies in a folder of its own number, so running again
    replaces it.
    """

    def __init__(self, store: TableStore, stream: str):
        self.store, self.folder = store, f"{store.root}/_streams/{stream}"

    def __contains__(self, batch_id: int) -> bool:
        path = self.store.path(f"{self.folder}/applied/batch={batch_id}/_SUCCESS")
        return path.getFileSystem(self.store.spark._jsc.hadoopConfiguration()).exists(path)

    def reject(self, batch_id: int, tokens: DataFrame) -> None:
        tokens.write.mode("overwrite").parquet(f"{self.folder}/rejected/batch={batch_id}")

    def enter(self, batch_id: int, notices: int, now: Column) -> None:
        row = self.store.spark.range(1).select(F.lit(notices).cast("bigint").alias("notices"), now.alias("applied_at"))
        row.write.mode("overwrite").parquet(f"{self.folder}/applied/batch={batch_id}")

    def read(self) -> DataFrame:
        """(batch, notices, applied_at)"""
        return self.store.spark.read.schema("notices BIGINT, applied_at TIMESTAMP, batch BIGINT").parquet(f"{self.folder}/applied")

    def rejected(self) -> DataFrame:
        """(batch, resource, event, token)"""
        return self.store.spark.read.schema("resource STRING, event STRING, token STRING, batch BIGINT").parquet(f"{self.folder}/rejected")


class ApplyChanges:
    """Applies each micro-batch to the store, once.

    `payloads` gives, per table, the current records (id, raw_payload, and the
    parsed `payload` if there is one) of a frame of ids; `PayloadArchive.of`
    reads no more than those ids ask for. Tables are changed side by side. In
    each, deletions come first, so a record that still exists wins over its own
    notice of destruction. A batch that is delivered again is skipped.
    """

    def __init__(
        self,
        store: TableStore,
        payloads: dict[str, Callable[[DataFrame], DataFrame]],
        now: Column | None = None,
        refresh_movements: Callable[[], object] | None = None,
        availability: Callable[[DataFrame], DataFrame] | None = None,
        stream: str = "changes",
    ):
        self.store, self.payloads = store, payloads
        self.now = F.current_timestamp() if now is None else now
        self.refresh_movements, self.availability = refresh_movements, availability
        self.applied = AppliedBatches(store, stream)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id in self.applied:
            return
        with self.store.scratch(batch) as notices:
            self.applied.reject(batch_id, rejected_ids(notices.rows))
            self._apply(notices.rows)
            self.applied.enter(batch_id, notices.measures["rows"], self.now)

    def _apply(self, notices: DataFrame) -> None:
        kinds = F.collect_set(F.struct("table_name", "destroyed"))
        with self.store.scratch(coalesced(notices), kinds=kinds) as written:
            seen = {(k["table_name"], k["destroyed"]) for k in written.measures["kinds"]}

            def ids(table: str, destroyed: bool, name: str) -> DataFrame:
                return written.rows.filter(
                    (F.col("table_name") == table) & (F.col("destroyed") == destroyed)
                ).select(F.col("id").alias(name))

            def apply(table: str) -> None:
                if table == MOVEMENTS:
                    if self.refresh_movements and (table, False) in seen:
                        self.refresh_movements()
                    return
                if (table, True) in seen:
                    key = self.store.specs[table].key
                    self.store.mark_deleted(table, ids(table, True, key), self.now)
                if (table, False) in seen and table in self.payloads:
                    self._refresh(table, ids(table, False, "id"))

            tables = sorted({t for t, _ in seen})
            side_by_side(self.store.spark, *[partial(apply, t) for t in tables])

    def _refresh(self, table: str, ids: DataFrame) -> None:
        found = self.payloads[table](ids)
        if "payload" not in found.columns:
            found = found.withColumn("payload", F.parse_json("raw_payload"))
        with self.store.scratch(found) as written:  # parsed once for all tables made of it
            raw = written.rows
            if table == "orders":
                self.store.upsert("orders", order_headers(raw, self.now))
                self.store.replace_children(
                    "order_rows",
                    raw.select(F.col("id").alias("order_id")),
                    order_lines(raw, self.now),
                )
            elif table == "contacts":
                self.store.upsert("contacts", contact_rows(raw, self.now))
            else:
                self.store.upsert("products", product_rows(raw, self.now))
                if self.availability:
                    products = ids.select(F.col("id").alias("product_id"))
                    self.store.replace_children(
                        "product_availability", products, self.availability(products)
                    )


def start(
    events: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Run the stream; with `available_now` it stops after what is there."""
    trigger = {"availableNow": True} if available_now else {"processingTime": COALESCE_WINDOW}
    return (
        events.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
