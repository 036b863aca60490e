"""Loading what changed: by time, by id, whole, and finding what vanished."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tradelake.functions.coerce import snake_case
from tradelake.functions.predicates import live
from tradelake.operators import id_sets
from tradelake.operators.state import STATE, after_runs, run_records, save_runs
from tradelake.operators.snapshots import replace_snapshot
from tradelake.operators.store import Batch, TableStore
from tradelake.schemas import RESOURCES, Resource, TableSpec
from tradelake.sources.pages import page_columns, page_rows, table_schema_for
from tradelake.sources.reference_items import reference_rows

# How far a time-based run reaches back before its watermark, and
# the share of live rows a reconcile may delete.
OVERLAP = "INTERVAL 10 MINUTES"
MAX_MISSING_SHARE = 0.2
#: Changes that a limited run sorts in one task at most; the last of more is found by counting.
SORTED = 10_000

_BY_NAME = {r.name: r for r in RESOURCES}


def changed_since(df: DataFrame, column: str, watermark: Column | datetime | None) -> DataFrame:
    """Rows changed since the watermark, less the overlap; all without one."""
    if watermark is None:
        return df
    mark = watermark if isinstance(watermark, Column) else F.lit(watermark)
    return df.filter(F.col(column) >= mark.cast("timestamp") - F.expr(OVERLAP))


def newer_than(df: DataFrame, key: str, watermark: Column | int | None) -> DataFrame:
    """Rows with an id above the watermark; all without one."""
    if watermark is None:
        return df
    mark = watermark if isinstance(watermark, Column) else F.lit(watermark)
    return df.filter(F.col(key) > mark)


def next_changes(df: DataFrame, column: str, key: str, limit: int, after: tuple | None) -> DataFrame:
    """The `limit` oldest changes, beyond a (time, id) already loaded if there is one.

    Changes without a time come first, by id; a mark without a time lies among
    them. A few are sorted; of more, the last one is looked for, and no task
    holds more than its share of them.
    """
    if after is not None:
        time, number = (F.lit(v) for v in after)
        same = F.col(column).isNull() if after[0] is None else F.col(column) == time
        later = F.col(column).isNotNull() if after[0] is None else F.col(column) > time
        df = df.filter(later | (same & (F.col(key) > number)))
    if limit <= SORTED:
        return df.orderBy(F.col(column).asc_nulls_first(), key).limit(limit)
    found = _nth(df, F.unix_micros(column), limit)
    if found is None:
        return df
    time, before = found
    at = F.col(column).isNull() if time is None else F.unix_micros(column) == time
    earlier = F.lit(False) if time is None else F.col(column).isNull() | (F.unix_micros(column) < time)
    number, less = _nth(df.filter(at), F.col(key), limit - before)
    if number is None:
        inside, last = F.lit(False), F.col(key).isNull()
    else:
        inside, last = F.col(key).isNull() | (F.col(key) < number), F.col(key) == number
    # rows that agree in time and id: as many as fit
    return df.filter(earlier | (at & inside)).unionAll(df.filter(at & last).limit(limit - before - less))


def _nth(df: DataFrame, number: Column, n: int) -> tuple[int | None, int] | None:
    """The n-th smallest of whole numbers, NULL first, and how many are less; None if there are fewer.

    Numbers are counted by their first bits and then, of the part that holds the
    n-th, by further ones. At most 65,536 counts reach the driver at a time.
    """
    numbers = df.select(number.cast("bigint").alias("v"))
    low, high, known, rows = numbers.agg(F.min("v"), F.max("v"), F.count("v"), F.count(F.lit(1))).first()
    if n > rows:
        return None
    less = rows - known
    if n <= less:
        return None, 0
    while low < high:
        bits = max(0, (high - low).bit_length() - 16)
        part = F.shiftright("v", bits)
        counts = numbers.filter(F.col("v").between(low, high)).groupBy(part.alias("part")).agg(
            F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        for r in sorted(counts.collect(), key=lambda r: r["part"]):
            if less + r["n"] >= n:
                low, high = r["low"], r["high"]
                break
            less += r["n"]
    return low, less


def watermarks(key: str | None, column: str | None) -> dict[str, Column]:
    """The highest id and change time of a batch, measured while it is written."""
    return {
        "id": F.max(key if key else F.lit(None).cast("bigint")),
        "time": F.max(column if column else F.lit(None).cast("timestamp")),
    }


def reached(key: str, column: str) -> dict[str, Column]:
    """The last (time, id) of a batch in the order of `next_changes`, measured while it is written."""
    known = F.col(column).isNotNull()
    last = F.max(F.struct(known, column, key))
    return {"last_time": last[column], "last_id": last[key], "time": F.max(column)}


def _higher(old, new):
    """Watermarks only move forward."""
    return new if old is None or (new is not None and new > old) else old


#: Kinds of runs that their limit cut short; the second stopped among rows without a time.
PARTIAL, PARTIAL_UNTIMED = "partial", "partial untimed"


class Sync:
    """Loads of one deployment: a store and the time of the run.

    Records of runs gather until `save` writes them together.
    """

    def __init__(self, store: TableStore, now: datetime):
        self.store, self.now = store, now
        self._runs: list[dict] = []

    def _record(self, name: str, kind: str, rows: int, **marks) -> int:
        given = {k: v for k, v in marks.items() if v is not None}
        self._runs.append({"resource": name, "last_run_at": self.now, "last_run_kind": kind, "last_run_rows": rows, **given})
        return rows

    def state(self, name: str) -> dict:
        """What is known of a resource's runs, unsaved ones included; {} if there were none."""
        known = after_runs(self.store.read(STATE), run_records(self.store.spark, *self._runs))
        row = known.where(F.col("resource") == name).first()
        return row.asDict() if row else {}

    def save(self) -> int:
        saved = save_runs(self.store, *self._runs)
        self._runs.clear()
        return saved

    def _upsert(
        self, name: str, rows: DataFrame, kind: str, key: str | None, column: str | None
    ) -> int:
        old = self.state(name)
        with self.store.staged(name, rows, **watermarks(key, column)) as batch:
            count = self.store.upsert_staged(name, batch)
        return self._record(
            name, kind, count,
            watermark_id=_higher(old.get("watermark_id"), batch.measures["id"]),
            watermark_updated_on=_higher(old.get("watermark_updated_on"), batch.measures["time"]),
        )

    def _changes(
        self, name: str, source: DataFrame, column: str, key: str, old: dict, limit: int | None
    ) -> tuple[DataFrame, str]:
        """The changes a run takes, and its kind.

        A run that its limit cut short leaves the last (time, id) it loaded,
        and the next one goes on behind it. Only a run that has caught up
        reaches back by the overlap again. Rows without a time are taken by every
        run that finds them new: no watermark can tell that they are.
        """
        cut = old.get("last_run_kind") in (PARTIAL, PARTIAL_UNTIMED)
        mark = None if old.get("last_run_kind") == PARTIAL_UNTIMED else old.get("watermark_updated_on")
        if limit is not None and cut:
            return next_changes(source, column, key, limit, (mark, old["watermark_id"])), "sweep"
        rows = source.filter(F.col(column) >= F.lit(mark)) if cut and mark else changed_since(source, column, mark)
        if mark:
            untimed, known = source.filter(F.col(column).isNull()), self.store.read(name).select(key)
            rows = rows.unionByName(untimed.join(known, key, "left_anti").select(*source.columns))
        kind = "sweep" if mark else "backfill"
        return (rows if limit is None else next_changes(rows, column, key, limit, None)), kind

    def _reached(self, name: str, batch: Batch, old: dict, kind: str, limit: int | None) -> int:
        """Record a run by time: at its limit where it stopped, else the highest time."""
        seen, count = batch.measures, batch.measures["rows"]
        if limit is not None and count >= limit:
            kind = PARTIAL_UNTIMED if seen["last_time"] is None else PARTIAL
            return self._record(name, kind, count, watermark_updated_on=seen["last_time"], watermark_id=seen["last_id"])
        return self._record(name, kind, count, watermark_updated_on=_higher(old.get("watermark_updated_on"), seen["time"]))

    def by_updated(
        self, name: str, source: DataFrame, column: str = "updated_on", full: bool = False,
        limit: int | None = None,
    ) -> int:
        """Upsert the rows changed since the last run, at most `limit` of them."""
        key, old = self.store.specs[name].key, self.state(name)
        rows, kind = self._changes(name, source, column, key, {} if full else old, limit)
        with self.store.staged(name, rows, **reached(key, column)) as batch:
            self.store.upsert_staged(name, batch)
        return self._reached(name, batch, old, kind, limit)

    def by_id(self, name: str, source: DataFrame, full: bool = False) -> int:
        """Upsert the rows with ids above the last one seen."""
        key = self.store.specs[name].key
        mark = None if full else self.state(name).get("watermark_id")
        return self._upsert(name, newer_than(source, key, mark), "full" if full else "id", key, None)

    def reload(self, name: str, source: DataFrame, kind: str = "full") -> int:
        """Replace the whole table."""
        return self._record(name, kind, self.store.truncate_load(name, source))

    def reference(self, name: str, payloads: DataFrame) -> int:
        """Replace a reference table by the items of its payloads."""
        return self.reload(name, reference_rows(payloads, F.lit(self.now).cast("timestamp")))

    def orders(self, headers: DataFrame, lines: DataFrame, full: bool = False, limit: int | None = None) -> int:
        """Changed order headers, at most `limit` of them, and the lines of exactly those orders."""
        old = self.state("orders")
        changed, kind = self._changes("orders", headers, "updated_on", "order_id", {} if full else old, limit)
        with self.store.staged("orders", changed, **reached("order_id", "updated_on")) as batch:
            self.store.upsert_staged("orders", batch)
            parents = batch.rows.select("order_id").distinct()
            self.store.replace_children(
                "order_rows", parents, lines.join(parents, "order_id", "left_semi")
            )
        return self._reached("orders", batch, old, kind, limit)

    def pages(self, resource: str | Resource, pages: DataFrame, full: bool = False) -> int:
        """Load the result pages of a searchable resource by its mode.

        Columns only ever join a table: one that is missing in these pages
        stays, and so does the table's bucket count.
        """
        r = _BY_NAME[resource] if isinstance(resource, str) else resource
        columns = page_columns(pages)
        if not columns:
            return self._record(r.name, r.mode, 0)
        found, key = table_schema_for(columns), snake_case(r.key)
        known = self.store.specs.get(r.name) or TableSpec(r.name, found, key)
        fresh = [f for f in found.fields if f.name not in known.schema.fieldNames()]
        spec = self.store.register(replace(known, schema=T.StructType([*known.schema.fields, *fresh])))
        rows = page_rows(pages, columns, F.lit(self.now).cast("timestamp"))
        if r.mode == "full":
            return self.reload(r.name, rows)
        if r.mode == "id":
            return self.by_id(r.name, rows, full)
        column = snake_case(r.cursor)
        mark = None if full else self.state(r.name).get("watermark_updated_on")
        kind = "full" if full else "updated"
        return self._upsert(r.name, changed_since(rows, column, mark), kind, spec.key, column)

    def reconcile(self, name: str, source_ids: DataFrame) -> int | None:
        """Soft-delete live rows that are missing at the source.

        When the source gave no ids, or more than a fifth of the live rows
        would go, the source has failed: nothing happens, the run is recorded
        as refused and the result is None.
        """
        key = self.store.specs[name].key
        alive, there = self.store.read(name).filter(live()).select(key), source_ids.select(key)
        totals = {n: F.coalesce(F.sum(n), F.lit(0)) for n in ("ours", "theirs", "missing")}
        with self.store.scratch(id_sets.compared(alive, there), **totals) as pages:
            n = pages.measures
            if n["missing"] > n["ours"] * MAX_MISSING_SHARE or (n["ours"] and not n["theirs"]):
                self._record(name, "reconcile refused", n["missing"])
                return None
            gone = id_sets.missing(alive, there, pages.rows)
            return self._record(name, "reconcile", self.store.mark_deleted(name, gone, F.lit(self.now).cast("timestamp")))

    def derived(self, name: str, fetched: DataFrame, to_rows: Callable[[DataFrame], DataFrame]) -> int:
        """Reload a snapshot table from fetched payloads, unless they are malformed."""
        count, _ = replace_snapshot(self.store, name, fetched, to_rows)
        return self._record(name, "derived", count)
