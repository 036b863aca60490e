"""Date and time helpers. All instants are read in UTC."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def utc_text(ts: Column) -> Column:
    """Fixed-width text of an instant; it sorts like the instant itself."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+00"))


def month_start(ts: Column) -> Column:
    return F.trunc(F.to_date(ts), "MM")


def whole_units(unit: str, earlier: Column, later: Column) -> Column:
    """Whole units elapsed, e.g. 23 hours are 0 days."""
    return F.timestamp_diff(unit, earlier.cast("timestamp"), later)


def instant(text: Column) -> Column:
    """ISO text with an offset to an instant; seconds may be missing."""
    with_seconds = F.regexp_replace(text, r"(T\d\d:\d\d)(?=[Z+-]|$)", "$1:00")
    return F.when(F.substring(text, 17, 1) == ":", text).otherwise(with_seconds).cast("timestamp")
