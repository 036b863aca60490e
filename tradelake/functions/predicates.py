"""Business predicates. Each is two-valued: unknown inputs never drop a row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Order statuses that never count as sales. The name test catches
# new statuses of the same family, the ids survive renames.
NOT_SALES_PREFIX = "pending"
NOT_SALES_NAME = "cancelled"
NOT_SALES_IDS = (1, 5, 38, 47, 57, 77, 79)

# Purchase orders that are not yet committed.
NOT_COMMITTED_PREFIX = "draft"
NOT_COMMITTED_IDS = (6,)

# Purchase orders with nothing left to arrive.
CLOSED_PURCHASE_STATUSES = ("Completed", "Cancelled")


def _known_true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def live(is_deleted: str | Column = "is_deleted") -> Column:
    """Rows not soft-deleted; the flag is NULL on most rows."""
    return ~_known_true(F.col(is_deleted) if isinstance(is_deleted, str) else is_deleted)


def reportable_sale(name: str = "order_status_name", status_id: str = "order_status_id") -> Column:
    label = F.lower(F.col(name))
    excluded = (
        F.startswith(label, F.lit(NOT_SALES_PREFIX))
        | (label == NOT_SALES_NAME)
        | F.col(status_id).isin(*NOT_SALES_IDS)
    )
    return ~_known_true(excluded)


def committed_purchase(
    name: str = "order_status_name", status_id: str = "order_status_id"
) -> Column:
    excluded = F.startswith(F.lower(F.col(name)), F.lit(NOT_COMMITTED_PREFIX)) | F.col(
        status_id
    ).isin(*NOT_COMMITTED_IDS)
    return ~_known_true(excluded)


def still_open(name: str = "order_status_name") -> Column:
    """Three-valued on purpose: an order without a status is not listed."""
    return ~F.col(name).isin(*CLOSED_PURCHASE_STATUSES)


def _like(column: Column, term: str) -> Column:
    if (len(term) - len(term.rstrip("\\"))) % 2:
        raise ValueError("a search term must not end in an unescaped backslash")
    return F.like(F.lower(column), F.lower(F.lit(f"%{term}%")))


def any_column_like(term: str, *columns: str) -> Column:
    """Case-insensitive substring in any column; % and _ in the term are wildcards."""
    tests = [_like(F.col(c), term) for c in columns]
    result = tests[0]
    for test in tests[1:]:
        result = result | test
    return result


def joined_text(*columns: str) -> Column:
    """The columns joined by single blanks, NULL counting as empty."""
    parts: list[Column] = []
    for i, c in enumerate(columns):
        if i:
            parts.append(F.lit(" "))
        parts.append(F.coalesce(F.col(c), F.lit("")))
    return F.concat(*parts)


def joined_text_like(term: str, *columns: str) -> Column:
    """The same over the columns' joined text."""
    return _like(joined_text(*columns), term)
