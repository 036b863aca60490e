"""Exact decimal arithmetic that yields NULL instead of failing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def to_number(text: Column) -> Column:
    """Number text to DECIMAL(38,9), NULL when it is not a number."""
    return text.try_cast("decimal(38,9)")


def product(a: Column, b: Column) -> Column:
    """a * b at scale 9, NULL on overflow or NULL.

    Two DECIMAL(38,9) factors would lose digits below 1e-6, so the factors are
    narrowed first; DECIMAL(19,9) * DECIMAL(18,9) is exact. Factors too large
    to narrow take the wide form.
    """
    exact = F.round(a.try_cast("decimal(19,9)") * b.try_cast("decimal(18,9)"), 9)
    wide = F.try_multiply(a.cast("decimal(38,9)"), b.cast("decimal(38,9)"))
    return F.coalesce(exact.try_cast("decimal(38,9)"), wide.try_cast("decimal(38,9)"))


def difference(a: Column, b: Column) -> Column:
    """a - b at scale 9, NULL on overflow or NULL.

    Spark gives the difference of two DECIMAL(38,9) eight digits; one digit
    less before the point keeps all nine. Values too large for that take the
    wide form.
    """
    exact = a.try_cast("decimal(37,9)") - b.try_cast("decimal(37,9)")
    wide = F.try_subtract(a.cast("decimal(38,9)"), b.cast("decimal(38,9)"))
    return F.coalesce(exact, wide.try_cast("decimal(38,9)"))
