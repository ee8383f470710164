"""Connected components by hooking and pointer jumping, on edges that shrink every round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import durable


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node of the component.  edges: columns a, b of one type, null-free.

    Each round every node hooks to its smallest neighbour, chains are shortened, and the edges are rewritten to the
    labels; edges within one label go.  Nothing is collected but the count of edges left.
    """
    edges = durable(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = durable(labels.withColumn("label", F.col("node")))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hooked = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("p")).withColumn("p", F.least("n", "p"))
        hooked = durable(hooked)
        moving = True
        while moving:  # every chain halves in length each time, so a path of n nodes takes log n joins
            further = hooked.select(F.col("n").alias("m"), F.col("p").alias("q"))
            hooked = durable(hooked.join(further, F.col("p") == F.col("m")).select("n", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")))
            moving = not hooked.where("moved").isEmpty()
            hooked = hooked.select("n", "p")
        labels = durable(labels.join(hooked, F.col("label") == F.col("n"), "left")
                         .select("node", F.coalesce("p", "label").alias("label")))
        left = hooked.select(F.col("n").alias("a"), F.col("p").alias("pa"))
        right = hooked.select(F.col("n").alias("b"), F.col("p").alias("pb"))
        edges = durable(edges.join(left, "a").join(right, "b").where("pa <> pb")
                        .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    return labels
