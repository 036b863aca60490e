"""Connected components of an edge table, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tradelake.llm.staging import discard, staged


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node in edges (a, b); the label is the smallest node of its component.

    Each round takes the least label among the neighbours and then the label of
    the label, so a chain of n nodes needs about log n rounds. Rounds are
    written to the shared folder; only counts come to the driver. Nothing is
    grouped but by minimum, which is taken inside the tasks first.
    """
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    spark, kept, last = edges.sparkSession, [], []
    both = staged(both.where("a IS NOT NULL AND b IS NOT NULL").distinct(), "edges", kept)
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("label")), "labels", last)
    while True:
        made: list[str] = []
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("next"))
        up = labels.select(F.col("node").alias("at"), F.col("label").alias("up"))
        moved = staged(least.join(up, F.col("next") == F.col("at")).select("node", "up", (F.col("label") != F.col("up")).alias("moved")), "labels", made)
        labels = moved.select("node", F.col("up").alias("label"))
        discard(spark, last)
        last = made
        if not moved.where("moved").take(1):
            discard(spark, kept)
            return labels
