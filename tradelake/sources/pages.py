"""Result pages: column metadata plus rows as arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tradelake.functions.coerce import coerce, column_type, filled, snake_case

COLUMNS = "ARRAY<STRUCT<name: STRING, reportDataType: STRING>>"
PAGE = f"metaData STRUCT<columns: {COLUMNS}>, results ARRAY<ARRAY<VARIANT>>"


def page_columns(pages: DataFrame, page: str = "page") -> list[tuple[str, str]]:
    """The (name, type) of every column that some page has, by name.

    Only the column lists are read out of the pages, and only different ones are
    parsed; what reaches the driver are different columns. One name with two
    types that are stored differently is an error.
    """
    lists = pages.select(F.get_json_object(page, "$.metaData.columns").alias("l")).distinct()
    each = lists.select(F.explode(F.from_json("l", COLUMNS)).alias("c"))
    found = sorted((r["name"], r["reportDataType"]) for r in each.select("c.*").distinct().collect())
    types: dict[str, str] = {}
    for name, kind in found:
        if column_type(types.setdefault(name, kind)) != column_type(kind):
            raise ValueError(f"column {name} is {types[name]} on one page and {kind} on another")
    return list(types.items())


def table_schema_for(columns: list[tuple[str, str]]) -> T.StructType:
    """Schema of the table a resource's pages load into."""
    types = {snake_case(name): column_type(kind) for name, kind in columns}
    ddl = ", ".join(f"`{name}` {kind}" for name, kind in types.items())
    return T.StructType.fromDDL(f"{ddl}, when_upserted TIMESTAMP NOT NULL")


def page_rows(
    pages: DataFrame, columns: list[tuple[str, str]], now: Column, page: str = "page"
) -> DataFrame:
    """Typed rows of all pages, each read by its own page's column names.

    A row shorter than its page's names leaves NULLs, cells beyond the names
    have none and go. Of two columns with one name the last wins.
    """
    read = pages.select(F.inline(F.array(F.from_json(page, PAGE))))
    names = F.transform(F.col("metaData.columns"), lambda c: c["name"])
    # where each wanted name stands on this page, its last place; 0: not there
    backwards, size = F.reverse(names), F.size(names)
    places = [
        F.when(F.array_position(backwards, name) > 0, size + 1 - F.array_position(backwards, name)).otherwise(0)
        .cast("int").alias(f"_{k}")
        for k, (name, _) in enumerate(columns)
    ]
    placed = read.select(F.struct(*places).alias("at"), "results")  # once per page
    cells = placed.select("at", F.explode("results").alias("r"))

    def cell(k: int) -> Column:
        at = F.col(f"at._{k}")
        return F.when(at > 0, F.get("r", at - 1)).alias(f"_{k}")

    # Cells, their texts and their typed values are made one after the other: generators
    # keep Spark from making them in one method, too long for the JVM to compile.
    numbers = range(len(columns))
    found = cells.select(F.explode(F.array(F.struct(*[cell(k) for k in numbers]))).alias("c"))
    texts = F.struct(*[filled(F.col(f"c._{k}")).alias(f"_{k}") for k in numbers])
    read_out = found.select("c", F.explode(F.array(texts)).alias("t"))
    named = {
        snake_case(name): coerce(F.col(f"c._{k}"), kind, F.col(f"t._{k}")) for k, (name, kind) in enumerate(columns)
    }
    return read_out.select(
        *[c.alias(name) for name, c in named.items()], now.alias("when_upserted")
    )
