"""Typing of loosely typed values by a metadata type name."""

from __future__ import annotations

import string

from pyspark.sql import Column, functions as F

from tradelake.functions.json_text import is_text
from tradelake.functions.times import instant

# Metadata type names and the column type each becomes. Any other
# name is text.
COLUMN_TYPES = {
    "INTEGER": "bigint",
    "IDSET": "bigint",
    "BOOLEAN": "boolean",
    "PERIOD": "timestamp",
    "DATE": "timestamp",
    "DATETIME": "timestamp",
    "MONEY": "decimal(38,9)",
    "STRING": "string",
    "SEARCH_STRING": "string",
}

# Texts that mean true.
TRUE_TEXTS = ("true", "1", "yes")


def column_type(metadata_type: str) -> str:
    return COLUMN_TYPES.get(metadata_type, "string")


def snake_case(name: str) -> str:
    """camelCase to snake_case: every capital but a leading one starts a word."""
    out = []
    for i, letter in enumerate(name):
        if i and letter in string.ascii_uppercase:
            out.append("_")
        out.append(letter.lower())
    return "".join(out)


#: White space of all of Unicode: what \\s means with it.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trimmed(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.btrim(text, F.lit(_WHITE))


def filled(value: Column) -> Column:
    """A cell as text: text as it is, anything else as JSON text, empty as NULL."""
    return F.nullif(value.cast("string"), F.lit(""))


def _to_id(value: Column, text: Column) -> Column:
    items = value.try_cast("array<string>")
    single = F.when(F.size(items) == 1, F.get(items, F.lit(0)))
    return F.when(F.startswith(text, F.lit("[")), single).otherwise(text).cast("bigint")


def _to_flag(value: Column, text: Column) -> Column:
    text = trimmed(F.lower(text))
    # Not text: true unless zero, false or an empty array or object.
    truthy = ~text.isin("false", "0", "[]", "{}")
    return F.when(is_text(value), text.isin(*TRUE_TEXTS)).otherwise(truthy)


def coerce(value: Column, metadata_type: str, text: Column | None = None) -> Column:
    """A VARIANT cell as a column of its metadata type; `text` is `filled(value)`, if that is at hand.

    Empty values are NULL. An id list of one element is that element, a longer
    one NULL. Money goes from text to decimal directly. Anything that does not
    fit its type is an error.
    """
    target = column_type(metadata_type)
    text = filled(value) if text is None else text
    if target == "bigint":
        return _to_id(value, text)
    if target == "boolean":
        return _to_flag(value, text)
    if target == "timestamp":
        return instant(text)
    return text.cast(target)
