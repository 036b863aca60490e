"""Substring search through inverted lists of trigrams.

A row can only hold a term if it holds every run of three characters of the
term's literal parts. The lists name, for each trigram, the keys of the rows
that have it, so a search reads a few lists, then the folders of the rows they
agree on, and only these rows are tested against the pattern. Whatever the
lists say is a superset: answers are those of a full scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

GRAM = 3


def grams(text: Column) -> Column:
    """Different runs of three characters of a lowered text; NULL has none."""
    low = F.lower(text)
    places = F.sequence(F.lit(1), F.greatest(F.length(low) - (GRAM - 1), F.lit(1)))
    runs = F.transform(places, lambda i: F.substring(low, i, F.lit(GRAM)))
    return F.when(F.length(low) >= GRAM, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def literals(term: str) -> list[str]:
    """The parts of a LIKE term between its wildcards."""
    parts, escaped = [""], False
    for letter in term:
        if not escaped and letter == "\\":
            escaped = True
        elif not escaped and letter in "%_":
            parts.append("")
        else:
            parts[-1] += letter
            escaped = False
    return [p for p in parts if p]


class TextIndex:
    """The rows of a table in folders by a hash of their key, and the trigram lists of their texts.

    Keys are unique and not NULL. Both folders are written by `build` and can be
    read by any session; size `buckets` so that a folder holds about a gigabyte.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 16):
        self.spark, self.key, self.buckets = spark, key, buckets
        self.rows_path, self.lists_path = f"{path}/rows", f"{path}/lists"

    def _hash(self, column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def build(self, rows: DataFrame, texts: DataFrame) -> None:
        """Index `rows` by `texts`: the key and one or more text columns."""
        stored = rows.withColumn("row_bucket", self._hash(F.col(self.key)))
        stored.hint("rebalance", "row_bucket").sortWithinPartitions("row_bucket", self.key).write.partitionBy(
            "row_bucket").parquet(self.rows_path)
        all_grams = F.array_distinct(F.flatten(F.array(*[grams(F.col(c)) for c in texts.columns if c != self.key])))
        lists = texts.select(F.explode(all_grams).alias("gram"), F.col(self.key).alias("key")).select(
            "*", self._hash(F.col("key")).alias("row_bucket"), self._hash(F.col("gram")).alias("gram_bucket"))
        lists.hint("rebalance", "gram_bucket").sortWithinPartitions("gram_bucket", "gram").write.partitionBy(
            "gram_bucket").parquet(self.lists_path)

    def hits(self, term: str) -> DataFrame | None:
        """(row_bucket, key) of the rows that hold all trigrams of a term; None if it has none."""
        parts = F.array(*[F.lit(p) for p in literals(term)]).cast("array<string>")
        wanted = F.array_distinct(F.flatten(F.transform(parts, grams)))
        found = self.spark.range(1).select(F.explode(wanted).alias("gram")).select(
            "gram", self._hash(F.col("gram")).alias("part")).collect()  # at most as many as the term has letters
        if not found:
            return None
        lists = self.spark.read.parquet(self.lists_path)
        of_term = lists.filter(
            F.col("gram_bucket").isin(sorted({r["part"] for r in found})) & F.col("gram").isin(sorted(r["gram"] for r in found)))
        return of_term.groupBy("row_bucket", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= len(found)).drop("n")

    def candidates(self, term: str) -> DataFrame:
        """Rows that may hold a term, from the folders of those that do by their trigrams.

        A term without three literal characters in a row asks for all rows.
        """
        rows, hits = self.spark.read.parquet(self.rows_path), self.hits(term)
        if hits is None:
            return rows.drop("row_bucket")
        folders = [r[0] for r in hits.select("row_bucket").distinct().collect()]  # at most `buckets` numbers
        keys = hits.select(F.col("key").alias(self.key))
        return rows.filter(F.col("row_bucket").isin(folders)).join(keys, self.key, "left_semi").select(
            *[c for c in rows.columns if c != "row_bucket"])
