"""Keyed tables on plain Parquet, changed by dynamic partition overwrite.

A table is a folder partitioned by a hash bucket of its clustering column. A
change reads the buckets it touches and writes them again with Spark's
`partitionOverwriteMode=dynamic`, which replaces exactly the partitions that the
new rows lie in; a touched bucket that ends up empty is removed after that. Old
rows meet the changed keys of their buckets where they are read and stay in their
buckets, so only new rows are shuffled; keys beyond `KEYS` go bucket by bucket.
Whole loads go to a new folder. One small file per table names its folder, its
bucket count and its columns, which a later declaration can add to but not take
from.

A table has one writer at a time. Every change replaces rows by key, so one that
was cut short is simply run again. A frame read before a change must not be
evaluated after it: `scratch` keeps rows that have to outlive one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import replace
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from tradelake.operators.keyed import latest_per_key, marked_deleted, without
from tradelake.schemas import TABLES, TableSpec, conform, typed

BUCKET = "kb"
#: Keys that are broadcast at a time to the buckets they change, at most; a
#: bucket with more is joined as the planner likes.
KEYS = 4_000_000
#: A change leaves kept rows in files of their own while the buckets it touches
#: have at most this many files each, and one more per so many bytes.
FILES, FILE_BYTES = 4, 16 << 20
#: Tables are written several times before they are read: smaller files are worth their time.
CODEC = "zstd"


class Batch(NamedTuple):
    """Written rows, what was measured while they were written, and the columns that were given."""

    rows: DataFrame
    measures: dict
    given: list[str]


def _fits(rows: DataFrame, field: T.StructField) -> bool:
    """Whether a column of `rows` is a decimal, of which the type of `field` holds every value."""
    if field.name not in rows.columns:
        return False
    have, want = rows.schema[field.name].dataType, field.dataType
    return (isinstance(have, T.DecimalType) and isinstance(want, T.DecimalType)
            and have.scale <= want.scale and have.precision - have.scale <= want.precision - want.scale)


class TableStore:
    def __init__(self, spark: SparkSession, root: str, specs: dict[str, TableSpec] | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.specs = dict(TABLES if specs is None else specs)
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- what is stored

    def _stored(self, name: str) -> dict:
        """Folder, bucket count and columns of a table; {} if there is none."""
        path = self.path(f"{self.root}/{name}/_table.json")
        if not self._fs.exists(path):
            return {}
        stream = self._fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _point(self, name: str, folder: str, spec: TableSpec | None = None) -> None:
        """Make a folder the table's current one, in one rename; the one before is deleted."""
        holds = {"folder": folder}
        if spec:
            holds |= {"buckets": spec.buckets, "schema": spec.schema.jsonValue()}
        old, base, jvm = self._stored(name).get("folder"), f"{self.root}/{name}", self.spark._jvm
        self._fs.mkdirs(self.path(f"{base}/{folder}"))
        draft = self._fs.makeQualified(self.path(f"{base}/_{uuid.uuid4().hex}.draft"))
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(holds).encode()))
        stream.close()
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        files.rename(draft, self._fs.makeQualified(self.path(f"{base}/_table.json")), options)
        if old and old != folder:
            self._fs.delete(self.path(f"{base}/{old}"), True)

    def register(self, spec: TableSpec) -> TableSpec:
        """Declare a table, or a wider schema for one; old rows read NULL there."""
        self.specs[spec.name] = spec
        return spec

    def spec(self, name: str) -> TableSpec:
        """A declared table with the stored columns it leaves out and the stored bucket count."""
        spec, stored = self.specs[name], self._stored(name)
        if "schema" not in stored:
            return spec
        declared = {f.name: f.dataType for f in spec.schema.fields}
        old = T.StructType.fromJson(stored["schema"]).fields
        if clash := [f.name for f in old if declared.get(f.name, f.dataType) != f.dataType]:
            raise ValueError(f"{name}: stored with another type: {clash}")
        kept = [T.StructField(f.name, f.dataType) for f in old if f.name not in declared]
        return replace(spec, schema=T.StructType([*spec.schema.fields, *kept]), buckets=stored["buckets"])

    def exists(self, name: str) -> bool:
        return bool(self._stored(name))

    def read(self, name: str) -> DataFrame:
        """The current rows of a table."""
        return self._scan(self.spec(name)).drop(BUCKET)

    def _scan(self, spec: TableSpec) -> DataFrame:
        schema = T.StructType([*spec.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        folder = self._stored(spec.name).get("folder")
        if not folder:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{spec.name}/{folder}")

    # -- batches

    @contextmanager
    def scratch(self, rows: DataFrame, **measures: Column) -> Iterator[Batch]:
        """Rows as a written table, dropped afterwards, and aggregates of them.

        What made the rows runs once, and lost executors only re-read files. The
        aggregates come from the pass that writes, in its last stage, where a
        task that is run twice counts once.
        """
        path = f"{self.root}/_staging/{uuid.uuid4().hex}"
        seen = Observation()
        aggregates = {"rows": F.count(F.lit(1)), **measures}
        rows.observe(seen, *[c.alias(name) for name, c in aggregates.items()]).write.option("compression", CODEC).parquet(path)
        try:
            yield Batch(self.spark.read.schema(rows.schema).parquet(path), seen.get, rows.columns)
        finally:
            self._fs.delete(self.path(path), True)

    def _typed(self, spec: TableSpec, rows: DataFrame, *, widen: bool = True) -> DataFrame:
        """Rows of the table's schema; a NULL in a required column is an error.

        Without `widen`, decimals that fit theirs whatever they hold stay as narrow as they are.
        """
        required = {f.name for f in spec.schema.fields if not f.nullable}

        def checked(column: str, data_type: T.DataType) -> Column:
            if column not in required:
                return F.col(column)
            problem = F.raise_error(f"{spec.name}.{column} must not be NULL").cast(data_type)
            return F.when(F.col(column).isNull(), problem).otherwise(F.col(column)).alias(column)

        further = [c for c in (BUCKET,) if c in rows.columns]
        kept = set() if widen else {f.name for f in spec.schema.fields if _fits(rows, f)}
        conformed = rows.select(*[F.col(f.name) if f.name in kept else typed(rows, f) for f in spec.schema.fields], *further)
        return conformed.select(*[checked(f.name, f.dataType) for f in spec.schema.fields], *further)

    @contextmanager
    def staged(self, name: str, rows: DataFrame, **measures: Column) -> Iterator[Batch]:
        """A batch for a table as scratch, typed and checked; narrow decimals get their width when they are written."""
        spec = self.spec(name)
        with self.scratch(self._typed(spec, rows, widen=False), **measures) as batch:
            yield batch._replace(given=[c for c in spec.schema.fieldNames() if c in rows.columns])

    # -- buckets

    def _bucket(self, spec: TableSpec, rows: DataFrame) -> Column:
        field = spec.schema[spec.cluster_column]
        return F.pmod(F.xxhash64(typed(rows, field)), F.lit(spec.buckets)).cast("int")

    def _gathered(self, spec: TableSpec, rows: DataFrame) -> DataFrame:
        """Rows of the table's schema and their bucket, gathered by bucket.

        The rebalance hint gathers each bucket in as few tasks as its size asks
        for and splits large ones. Only given columns are shuffled, as they are:
        others join them behind the shuffle, where all get their types.
        """
        given = [c for c in spec.schema.fieldNames() if c in rows.columns]
        moved = rows.select(*given, self._bucket(spec, rows).alias(BUCKET)).hint("rebalance", BUCKET)
        return self._typed(spec, moved)

    def _write(self, spec: TableSpec, folder: str, rows: DataFrame) -> int:
        """Write rows into their buckets, in place of what these held, and count them.

        Sorting inside files makes row groups skippable by the clustering column.
        """
        seen = Observation()
        (
            rows.sortWithinPartitions(BUCKET, spec.cluster_column)
            .observe(seen, F.count(F.lit(1)).alias("rows"))
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", CODEC)
            .partitionBy(BUCKET).parquet(f"{self.root}/{spec.name}/{folder}")
        )
        return seen.get["rows"]

    def _files(self, spec: TableSpec, folder: str, buckets: list[int]) -> dict[str, dict[str, int]]:
        """Names and sizes of the files of some buckets, by bucket folder."""
        out = {}
        for path in (f"{self.root}/{spec.name}/{folder}/{BUCKET}={b}" for b in buckets):
            if self._fs.exists(self.path(path)):
                out[path] = {s.getPath().getName(): s.getLen() for s in self._fs.listStatus(self.path(path))}
        return out

    def _parts(self, spec: TableSpec, touching: DataFrame, keys: DataFrame) -> Iterator[tuple[list[int], DataFrame]]:
        """The buckets that hold `touching` and `keys`, in parts of at most KEYS keys, and the keys of each part.

        Keys that do not tell their bucket stay together.
        """
        touching, apart = touching.select(spec.cluster_column), spec.cluster_column in keys.columns
        counted = touching.select(self._bucket(spec, touching).alias(BUCKET), F.lit(0).alias("n"))
        if apart:
            counted = counted.unionAll(keys.select(self._bucket(spec, keys), F.lit(1)))
        # At most spec.buckets numbers reach the driver.
        sizes = {r[0]: r[1] for r in counted.groupBy(BUCKET).agg(F.sum("n")).collect()}
        parts: list[list[int]] = []
        for bucket in sorted(sizes):
            if parts and (not apart or sum(sizes[b] for b in [*parts[-1], bucket]) <= KEYS):
                parts[-1].append(bucket)
            else:
                parts.append([bucket])
        for part in parts:
            own = keys.filter(self._bucket(spec, keys).isin(part)) if len(parts) > 1 else keys
            yield part, F.broadcast(own) if apart and sum(sizes[b] for b in part) <= KEYS else own

    def _change(
        self, name: str, touching: DataFrame, keys: DataFrame,
        change: Callable[[DataFrame, DataFrame], DataFrame], rows: DataFrame | None = None,
    ) -> None:
        """Apply change(old rows, keys) to the buckets that hold `touching` and `keys`; `rows` join them there.

        What is kept stays in its bucket without a shuffle, in files of its own,
        until these are many: then they are gathered again.
        """
        spec, stored = self.spec(name), self._stored(name)
        folder = stored.get("folder") or f"d-{uuid.uuid4().hex[:8]}"
        changed = False
        for part, own in self._parts(spec, touching, keys):
            before = self._files(spec, folder, part)
            sizes = [size for files in before.values() for size in files.values()]
            new = change(self._scan(spec).filter(F.col(BUCKET).isin(part)), own)
            many = len(sizes) > FILES * len(part) + sum(sizes) // FILE_BYTES
            if many:
                new = new.hint("rebalance", BUCKET)
            if rows is not None:
                new = new.unionByName(self._gathered(spec, rows.filter(self._bucket(spec, rows).isin(part))))
            self._write(spec, folder, new)
            for path, files in self._files(spec, folder, part).items():
                if files.keys() & before.get(path, {}).keys():  # not written again: its rows are gone
                    self._fs.delete(self.path(path), True)
            changed = True
        if changed and stored.get("schema") != spec.schema.jsonValue():
            self._point(name, folder, spec)

    # -- writes

    def truncate_load(self, name: str, rows: DataFrame) -> int:
        """Replace the whole table, in as many buckets as declared; an empty frame empties it."""
        spec = replace(self.spec(name), buckets=self.specs[name].buckets)
        folder = f"d-{uuid.uuid4().hex[:8]}"
        count = self._write(spec, folder, self._gathered(spec, rows))
        self._point(name, folder, spec)
        return count

    def upsert(self, name: str, rows: DataFrame, tie_break: tuple[str, ...] = ()) -> int:
        """Newest row per key replaces or joins the table; returns the rows given."""
        with self.staged(name, rows) as batch:
            return self.upsert_staged(name, batch, tie_break)

    def upsert_staged(self, name: str, batch: Batch, tie_break: tuple[str, ...] = ()) -> int:
        spec, count = self.spec(name), batch.measures["rows"]
        if not spec.unique:
            raise ValueError(f"{name}.{spec.key} does not tell rows apart: replace the rows of a parent instead")
        if count:
            needed = {*batch.given, spec.key, spec.cluster_column, spec.order_col, *tie_break}
            own = batch.rows.select(*[c for c in batch.rows.columns if c in needed])
            # Ranking would shuffle whole rows once more: it is left out where no key repeats.
            unique = own.groupBy(spec.key).agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1").isEmpty()
            newest = own if unique else latest_per_key(own, spec.key, spec.order_col, tie_break)
            # A child table is clustered by its parent, so the old row of a key
            # may lie in a bucket the new one does not: those buckets change too.
            touching = batch.rows.select(spec.cluster_column)
            if spec.cluster_column != spec.key:
                old = self.read(name).join(batch.rows.select(spec.key), spec.key, "left_semi")
                touching = touching.unionAll(old.select(spec.cluster_column))
            self._change(
                name, touching, batch.rows.select(spec.key),
                lambda old, keys: without(old, keys, spec.key), newest,
            )
        return count

    def replace_children(self, name: str, parents: DataFrame, rows: DataFrame) -> int:
        """Replace all rows of the given parents; returns the rows given."""
        parent_field = self.specs[name].cluster_column
        with (
            self.staged(name, rows) as batch,
            self.scratch(parents.select(parent_field).distinct()) as replaced,
        ):
            self._change(
                name, batch.rows.select(parent_field), replaced.rows,
                lambda old, gone: without(old, gone, parent_field), batch.rows.select(*batch.given),
            )
        return batch.measures["rows"]

    def mark_deleted(self, name: str, ids: DataFrame, now: Column) -> int:
        """Soft-delete the given ids; returns how many were given."""
        key = self.specs[name].key
        with self.scratch(ids.select(key)) as given:
            if given.measures["rows"]:
                self._change(name, given.rows, given.rows, lambda old, ids: marked_deleted(old, ids, key, now))
        return given.measures["rows"]

    # -- tables in folders of another make

    def publish(self, name: str, write: Callable[[str], object]) -> object:
        """Write a table as one folder by `write(path)` and make it current; returns what `write` does."""
        folder = f"d-{uuid.uuid4().hex[:8]}"
        result = write(f"{self.root}/{name}/{folder}")
        self._point(name, folder)
        return result

    def published(self, name: str) -> str:
        """The current folder of a table made by `publish`."""
        return f"{self.root}/{name}/{self._stored(name)['folder']}"
