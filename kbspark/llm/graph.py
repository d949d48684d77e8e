"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b). Returns (node, label): the least node that each node of an edge can reach.

    Each round gives a node the least label around it, then the label of that label; so the rounds
    grow with the logarithm of a component's diameter. Every round is written to the shared folder, and
    its predecessor deleted.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")))
    while True:
        around = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("__n")).agg(F.min("label").alias("__m"))
        near = labels.join(around, F.col("node") == F.col("__n")).select("node", F.col("label").alias("old"), F.least("label", "__m").alias("label"))
        up = labels.select(F.col("node").alias("__n"), F.col("label").alias("__up"))
        new = written(near.join(up, F.col("label") == F.col("__n")).select("node", "old", F.least("label", "__up").alias("label")))
        discard(labels)
        if new.filter("label != old").isEmpty():
            discard(both)
            return new
        labels = new
