"""Small reference collections of varying shape to (id, name, raw_payload) rows.

Keys are looked at in document order, which the JSON text keeps and VARIANT
does not; types come from VARIANT, since text alone cannot tell "5" from 5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tradelake.functions.json_text import is_array, is_object, is_text
from tradelake.schemas import REFERENCE_ITEMS, conform

# Keys that may hold an item's name, best first.
NAME_KEYS = ("name", "code", "description", "title")
NAME_SUFFIX = "name"
ID_SUFFIX = "id"
PARENT_SUFFIX = "parentid"


def _object_texts(texts: Column, values: Column) -> Column:
    """The texts whose value is an object."""
    pairs = F.arrays_zip(texts.alias("t"), values.alias("v"))
    kept = F.filter(pairs, lambda p: is_object(p["v"]))
    return F.transform(kept, lambda p: p["t"])


def item_texts(payload: Column) -> Column:
    """The items of a payload, as JSON texts.

    An array gives its objects. An object whose keys are all digits and whose
    values are all objects gives those values; any other object is one item.
    """
    shape = F.try_parse_json(payload)
    as_map = F.from_json(payload, "MAP<STRING, VARIANT>")
    keyed = (F.size(as_map) > 0) & F.forall(
        F.map_entries(as_map),
        lambda e: e["key"].rlike("^[0-9]+$") & is_object(e["value"]),
    )
    from_array = _object_texts(
        F.from_json(payload, "ARRAY<STRING>"), F.from_json(payload, "ARRAY<VARIANT>")
    )
    from_map = F.map_values(F.from_json(payload, "MAP<STRING, STRING>"))
    return (
        F.when(is_array(shape), from_array)
        .when(is_object(shape) & keyed, from_map)
        .when(is_object(shape), F.array(payload))
    )


def _ends_with(key: Column, suffix: str) -> Column:
    return F.endswith(F.lower(key), F.lit(suffix))


def item_id(item: Column, values: Column) -> Column:
    """`id` if there is one, else the first key ending in id that is no parent id."""
    keys = F.json_object_keys(item)
    own = F.filter(keys, lambda k: _ends_with(k, ID_SUFFIX) & ~_ends_with(k, PARENT_SUFFIX))
    key = F.when(F.map_contains_key(values, "id"), F.lit("id")).otherwise(F.get(own, F.lit(0)))
    return F.try_element_at(values, key).cast("string")


def item_name(item: Column, values: Column) -> Column:
    """The first non-empty text among the name keys, then among *name keys in
    document order, then the text of a name object."""

    def text_at(key: Column) -> Column:
        value = F.try_element_at(values, key)
        return F.when(is_text(value), F.nullif(value.cast("string"), F.lit("")))

    named = F.transform(
        F.filter(F.json_object_keys(item), lambda k: _ends_with(k, NAME_SUFFIX)), text_at
    )
    inner = F.try_variant_get(F.try_element_at(values, F.lit("name")), "$.text", "variant")
    return F.coalesce(
        *[text_at(F.lit(k)) for k in NAME_KEYS],
        F.get(F.filter(named, lambda n: n.isNotNull()), F.lit(0)),
        F.when(is_text(inner), inner.cast("string")),
    )


def reference_rows(payloads: DataFrame, now: Column, payload: str = "payload") -> DataFrame:
    """Rows of a reference table from the payloads of its collection."""
    values = F.col("values")
    df = (
        payloads.select(F.explode(item_texts(F.col(payload))).alias("item"))
        .withColumn("values", F.from_json("item", "MAP<STRING, VARIANT>"))
        .select(
            item_id(F.col("item"), values).alias("id"),
            item_name(F.col("item"), values).alias("name"),
            F.col("item").alias("raw_payload"),
            now.alias("when_upserted"),
        )
    )
    return conform(df, REFERENCE_ITEMS)
