"""Snapshot tables: replaced whole, and only by what was fetched without a fault."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from tradelake.functions.json_text import is_object
from tradelake.operators.store import TableStore


class MalformedPayload(ValueError):
    """A payload has a shape that must not be taken for an empty one."""


def usable_payloads(
    fetched: DataFrame, payload: str = "raw_payload", status: str = "status"
) -> tuple[DataFrame, DataFrame]:
    """Split fetched payloads into (usable, rejects), or raise.

    One pass over the input decides before anything is replaced. A request the
    source refused for a bad id (status 400) is a reject. Any other failure, or
    a payload that is neither an object nor null, aborts.
    """
    refused = F.coalesce(F.col(status) == 400, F.lit(False))
    failed = ~refused & F.coalesce(F.col(status) != 200, F.lit(False))
    value = F.try_parse_json(payload)
    # text that is no JSON at all parses to NULL
    empty = F.col(payload).isNull() | F.coalesce(F.is_variant_null(value), F.lit(False))
    odd = ~refused & ~failed & ~empty & ~is_object(value)
    problems = fetched.agg(F.count_if(failed).alias("failed"), F.count_if(odd).alias("odd")).first()
    if problems["failed"] or problems["odd"]:
        raise MalformedPayload(
            f"{problems['failed']} failed requests, {problems['odd']} malformed payloads"
        )
    return fetched.filter(~refused & ~empty), fetched.filter(refused)


def replace_snapshot(
    store: TableStore, name: str, fetched: DataFrame, to_rows: Callable[[DataFrame], DataFrame]
) -> tuple[int, DataFrame]:
    """Load a snapshot table from fetched payloads; the old one stays on failure.

    The payloads are written first, so what was checked is what is loaded. The
    rejects are rows of that copy, which stays in the work folder.
    """
    folder = f"{store.root}/_fetched/{name}-{uuid.uuid4().hex}"
    fetched.write.parquet(folder)
    usable, rejects = usable_payloads(store.spark.read.schema(fetched.schema).parquet(folder))
    return store.truncate_load(name, to_rows(usable)), rejects
