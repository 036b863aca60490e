"""Bounded samples of labelled rows, and the held-out split, for the fitted scorers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def held_out(doc_id: Column, parts: int = 5) -> Column:
    """Rows never learned from: crc32 of the id as text leaves 0. A null id is never learned from either."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == 0, F.lit(True))


def sample(labels: DataFrame, label: str, size: int) -> DataFrame:
    """At most `size` labelled ids (doc_id, y) outside the held-out part.

    The choice is by hash of the id, so it is the same at every run and blind
    to the order of rows. An id with several labels takes the larger; an id or
    label that is null is left out. With its row bound it may be broadcast.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
