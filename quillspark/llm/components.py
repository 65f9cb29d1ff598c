"""Connected components of edges between long ids, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def relabelled(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (id, label), edges (a, b) between labels: the table again, where
    labels that edges connect have become the smallest among them.

    Each round hooks every vertex to its smallest neighbour, follows hooks once
    more, and contracts the edges; the number of rounds grows with the logarithm
    of the longest path. Tables are written each round; nothing but an edge
    count comes to the driver.
    """
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    used = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("p"))
        up = hook.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        parent = stored(hook.join(up, "p", "left").select("a", F.coalesce("pp", "p").alias("p")))
        labels = labels.join(parent.withColumnRenamed("a", "label"), "label", "left").select("id", F.coalesce("p", "label").alias("label"))
        moved = edges.join(parent, "a").select(F.col("p").alias("a"), "b")
        moved = moved.join(parent.select(F.col("a").alias("b"), F.col("p").alias("q")), "b").select("a", F.col("q").alias("b"))
        used.append(edges)
        edges = stored(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        used.append(parent)
    out = stored(labels)
    discard(*used, edges)
    return out
