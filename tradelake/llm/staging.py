"""Intermediate tables in the shared work folder."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tradelake.session import work_folder


_scopes: list[list[str]] = []


@contextmanager
def noted(made: list[str]) -> Iterator[None]:
    """`made` gets the folder of whatever is staged inside."""
    _scopes.append(made)
    try:
        yield
    finally:
        del _scopes[next(k for k, s in enumerate(_scopes) if s is made)]


def staged(df: DataFrame, purpose: str, made: list[str] | None = None) -> DataFrame:
    """df written as Parquet and read again: lineage ends here, and a lost executor costs no recomputation.

    `made` gets the folder, for tables that nothing returned reads any more
    once a job is done (see `discard`).
    """
    folder = work_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    for holder in (*_scopes, *([] if made is None else [made])):
        holder.append(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def discard(spark: SparkSession, made: list[str]) -> None:
    """Delete staged tables."""
    for folder in made:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    made.clear()


_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that ends inside go with it, and not once the driver collects garbage."""
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREE) if before is None else spark.conf.set(_FREE, before)
