"""Shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from tradelake.sources.testdata import adapter_ctes

TIME_TEXT = "yyyy-MM-dd HH:mm:ss"
SQL_TIME_TEXT = "%Y-%m-%d %H:%M:%S"


def plain(df: DataFrame) -> DataFrame:
    """Only BIGINT, DOUBLE, STRING and BOOLEAN columns, as both engines have them."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        match field.dataType:
            case T.DecimalType() | T.FloatType():
                c = c.cast("double")
            case T.IntegerType() | T.ShortType() | T.ByteType():
                c = c.cast("bigint")
            case T.TimestampType() | T.TimestampNTZType():
                c = F.date_format(c, TIME_TEXT)
            case T.DateType():
                c = c.cast("string")
            case T.ArrayType():
                c = F.array_join(c, "|")
        out.append(c.alias(field.name))
    return df.select(*out)


def sql_time(expression: str) -> str:
    return f"strftime({expression}, '{SQL_TIME_TEXT}')"


def with_adapters(adapters: str, *ctes: str, select: str) -> str:
    """A DuckDB query over ERP adapters and further named subqueries."""
    items = [adapter_ctes(*adapters.split()), *ctes]
    return "WITH " + ",\n".join(i.strip() for i in items if i.strip()) + "\n" + select.strip()
