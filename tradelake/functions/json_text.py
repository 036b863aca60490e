"""Scalars out of JSON text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_NESTED = "^(OBJECT|ARRAY)"


def scalar_text(value: Column) -> Column:
    """A VARIANT as text, or NULL when it holds an object, an array or null."""
    return F.when(~F.schema_of_variant(value).rlike(_NESTED), value.cast("string"))


def is_object(value: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.lit(False))


def is_array(value: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit("ARRAY")), F.lit(False))


def is_text(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))
