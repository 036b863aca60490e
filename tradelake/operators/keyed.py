"""Changes to keyed tables as DataFrame expressions: old rows in, new rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest_per_key(
    df: DataFrame, key: str, order_col: str = "when_upserted", tie_break: tuple[str, ...] = ()
) -> DataFrame:
    """The newest row per key; NULL keys form one group.

    `row_number() = 1` is cut to one row per key inside each task before the
    shuffle, so a key with a huge share of the rows sends one row per task.
    """
    order = [F.desc(order_col), *[F.asc(c) for c in tie_break]]
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def without(target: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not among `keys`, which may hold one more than once; a NULL key equals nothing."""
    return target.join(keys.select(key), key, "left_anti").select(*target.columns)


def upserted(target: DataFrame, batch: DataFrame, newest: DataFrame, key: str) -> DataFrame:
    """Target with `newest`, the batch's latest row per key, in place of equal keys.

    The batch itself names the keys to drop, so ranking it runs once. A NULL
    key equals nothing: its row is added.
    """
    return without(target, batch, key).unionByName(newest)


def marked_deleted(target: DataFrame, ids: DataFrame, key: str, now: Column) -> DataFrame:
    """Live rows of the given ids flagged; an earlier deleted_at stays."""
    flagged = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    dies = F.col("_hit") & ~F.coalesce("is_deleted", F.lit(False))
    joined = target.join(flagged, key, "left")
    changed = joined.withColumn(
        "deleted_at", F.when(dies, now).otherwise(F.col("deleted_at"))
    ).withColumn("is_deleted", F.when(dies, F.lit(True)).otherwise(F.col("is_deleted")))
    return changed.select(*target.columns)


def running_sequence(
    df: DataFrame, key: str, order: list[str | Column], chunk: Column, name: str = "seq"
) -> DataFrame:
    """Number the rows of each key 1, 2, ... in `order`.

    A key may hold any share of the rows, so its rows are never sorted in one
    task. `chunk` is a coarse position that never decreases along `order`: rows
    are numbered inside (key, chunk), and the sizes of the key's earlier chunks
    are added. Only those sizes, one row per (key, chunk), meet per key.
    """
    df = df.withColumn("_chunk", chunk)
    by_key = Window.partitionBy("_key").orderBy("_part")
    before = F.coalesce(
        F.sum("_rows").over(by_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    offsets = (
        df.groupBy(F.col(key).alias("_key"), F.col("_chunk").alias("_part"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_key", "_part", before.alias("_before"))
    )
    inside = F.row_number().over(Window.partitionBy(key, "_chunk").orderBy(*order))
    same = F.col(key).eqNullSafe(F.col("_key")) & F.col("_chunk").eqNullSafe(F.col("_part"))
    return (
        df.withColumn("_inside", inside)
        .join(offsets, same)
        .withColumn(name, (F.col("_inside") + F.col("_before")).cast("bigint"))
        .drop("_chunk", "_inside", "_before", "_key", "_part")
    )
