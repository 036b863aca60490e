"""The log of questions: appended in full, shown in short."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tradelake.schemas import QUESTION_LOG, conform

# How much of its texts the short view of a log shows.
ARGUMENT_CHARS = 2000
DETAIL_CHARS = 500


def append_log(entries: DataFrame, path: str) -> None:
    """Append entries to the question log, texts in full."""
    conform(entries, QUESTION_LOG).write.mode("append").parquet(path)


def short_log(log: DataFrame) -> DataFrame:
    """A log for display: long texts are cut, and two columns give their full lengths."""
    return log.withColumns({
        "arguments": F.substring("arguments", 1, ARGUMENT_CHARS), "argument_chars": F.length("arguments"),
        "detail": F.substring("detail", 1, DETAIL_CHARS), "detail_chars": F.length("detail"),
    })


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUESTION_LOG).parquet(path)
