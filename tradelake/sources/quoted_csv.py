"""CSV records out of file splits, also where quoted cells hold line breaks.

A line break ends a record only if an even number of quotes stands before it.
What stands before a split is not known while it is read, so every split is
read under both assumptions: a line knows how many quotes and how many records
there are before it in its split if the split begins outside a quoted cell, and
if inside. Quote parities of the splits, combined in file order, then tell which
assumption holds, and how many records lie before each split. Lines meet once,
by their split, and no task holds more than one split.

A record belongs to the split it begins in. Only what a split holds of a record
begun earlier moves: one text per split at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

_SPLIT = ["_file", "_block"]


class UnpairedQuotes(ValueError):
    """A file whose quotes do not pair up."""


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all files, numbered in file order inside their split."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
        "value",
    )


def _marked(lines: DataFrame) -> DataFrame:
    """Per line, under both assumptions: whether it is inside a cell, and the records begun so far."""
    inside = Window.partitionBy(*_SPLIT).orderBy("_line")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2
    blank = F.trim(F.translate("value", "\r\t﻿", "   ")) == ""
    return (
        lines.withColumn("_turns", turns)
        .withColumn("_blank", blank)
        .withColumn("_parity", F.coalesce(F.sum("_turns").over(before), F.lit(0)) % 2)
        .withColumn("_begun_0", F.count_if((F.col("_parity") == 0) & ~F.col("_blank")).over(so_far))
        .withColumn("_begun_1", F.count_if((F.col("_parity") == 1) & ~F.col("_blank")).over(so_far))
    )


def _splits(marked: DataFrame) -> DataFrame:
    """Per split, whether it begins inside a cell and the records of its file begun before it."""
    in_file = Window.partitionBy("_file").orderBy("_block")
    earlier = in_file.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_file")
    unpaired = F.raise_error(F.concat(F.lit("quotes do not pair up in "), "_file")).cast("bigint")
    return (
        marked.groupBy(*_SPLIT)
        .agg(
            F.sum("_turns").alias("_turns"),
            F.max("_begun_0").alias("_total_0"), F.max("_begun_1").alias("_total_1"),
        )
        .withColumn("_inside", F.coalesce(F.sum("_turns").over(earlier), F.lit(0)) % 2)
        .withColumn("_total", F.when(F.col("_inside") == 0, F.col("_total_0")).otherwise(F.col("_total_1")))
        .withColumn("_before", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
        .withColumn("_before", F.when(F.sum("_turns").over(whole) % 2 == 1, unpaired).otherwise(F.col("_before")))
        .select(*_SPLIT, "_inside", "_before")
    )


def _joined_lines(texts: Column) -> Column:
    """Texts of (place, text) pairs in order, as the file holds them."""
    return F.array_join(F.transform(F.array_sort(texts), lambda t: t["text"]), "\n")


def records(spark: SparkSession, path: str) -> DataFrame:
    """(_file, _block, _pos, _number, text): every record of the files under `path`.

    `_pos` counts the records begun in a split from 0, `_number` those of the
    file from 1, which is the header. Blank lines outside cells are no records.
    Quotes inside a cell are doubled; a file whose quotes do not pair up is an
    error.
    """
    marked = _marked(_lines(spark, path))
    placed = marked.join(_splits(marked), _SPLIT)
    inside = (F.col("_parity") + F.col("_inside")) % 2 == 1
    begun = F.when(F.col("_inside") == 0, F.col("_begun_0")).otherwise(F.col("_begun_1"))
    pieces = (
        placed.filter(inside | ~F.col("_blank"))
        .groupBy(*_SPLIT, begun.alias("_begun"), (F.col("_before") + begun).alias("_number"))
        .agg(_joined_lines(F.collect_list(F.struct("_line", F.col("value").alias("text")))).alias("text"))
    )
    # what a split holds of a record begun in an earlier one
    tails = (
        pieces.filter("_begun = 0").groupBy("_file", "_number")
        .agg(_joined_lines(F.collect_list(F.struct("_block", "text"))).alias("_tail"))
    )
    text = F.concat_ws("\n", "text", "_tail")
    text = F.when(F.endswith(text, F.lit("\r")), F.substr(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    return pieces.filter("_begun > 0").join(tails, ["_file", "_number"], "left").select(
        *_SPLIT, (F.col("_begun") - 1).alias("_pos"), "_number", text.alias("text")
    )


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def read(spark: SparkSession, path: str) -> DataFrame:
    """CSV files with a header as text columns, and each record's _file, _block and _pos.

    All files must have one and the same header line.
    """
    names = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).columns
    schema = ", ".join(f"{_quoted(n)} STRING" for n in names)
    header = spark.read.option("lineSep", "\n").text(path).first()["value"].strip("﻿\r")
    first_line = F.rtrim(F.replace(F.element_at(F.split("text", "\n"), 1), F.lit("﻿"), F.lit("")), F.lit("\r"))
    other = (F.col("_number") == 1) & (first_line != F.lit(header))
    differs = F.raise_error(F.concat(F.lit("another header in "), "_file")).cast("string")
    found = records(spark, path).filter((F.col("_number") > 1) | other)
    cells = F.from_csv(F.when(other, differs).otherwise(F.col("text")), schema, {"quote": '"', "escape": '"', "multiLine": "true"})
    return found.select(cells.alias("_cells"), *_SPLIT, "_pos").select("_cells.*", *_SPLIT, "_pos")
