"""Sets of integer ids, compared as bitmaps of 32,768 ids each.

A page of ids is 4 KB however many of them there are, and partial bitmaps are
merged before they are shuffled. Two sets meet page by page, so how far they
differ is known before any row is joined, and then only ids of pages that differ
are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _known(ids: DataFrame) -> DataFrame:
    """(page, id) of a one-column frame; NULL is in no set."""
    known = ids.select(F.col(ids.columns[0]).cast("bigint").alias("id")).filter("id IS NOT NULL")
    return known.select(F.bitmap_bucket_number("id").alias("page"), "id")


def _bitmaps(ids: DataFrame, side: str) -> DataFrame:
    built = _known(ids).groupBy("page").agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))
    return built.select("page", "bits", F.lit(side).alias("side"))


def compared(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Per page, how many ids are in `ours` and `theirs`, and how many of ours are missing there."""

    def size(side: str | None = None) -> Column:
        bits = F.when(F.col("side") == side, F.col("bits")) if side else F.col("bits")
        return F.bitmap_count(F.bitmap_or_agg(F.coalesce(bits, F.unhex(F.lit("00")))))

    both = _bitmaps(ours, "ours").unionAll(_bitmaps(theirs, "theirs"))
    return both.groupBy("page").agg(
        size("ours").alias("ours"), size("theirs").alias("theirs"), (size() - size("theirs")).alias("missing"))


def missing(ours: DataFrame, theirs: DataFrame, pages: DataFrame) -> DataFrame:
    """Ours that are not among theirs; `pages` is their comparison."""
    differing = pages.filter("missing > 0").select("page")
    left, right = (_known(ids).join(differing, "page", "left_semi") for ids in (ours, theirs))
    return left.join(right, ["page", "id"], "left_anti").select(F.col("id").alias(ours.columns[0]))
