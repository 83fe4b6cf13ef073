"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each end of ``edges`` (a, b): the smallest node that it is connected with.

    Each round points every node at the smallest of itself and its neighbours,
    follows the pointer once more and contracts the edges along it; it ends
    when no edge is left, after a number of rounds in the logarithm of the
    longest path.  Neighbours are never gathered: a hub is one aggregated row.
    """
    labels = None
    edges = edges.filter("a <> b")
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        up = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p")), "parents")
        second = up.select(F.col("u").alias("w"), F.col("p").alias("pp"))
        up = materialise(up.join(second, F.col("p") == F.col("w")).select("u", F.col("pp").alias("p")), "parents")
        if labels is None:
            labels = up.select(F.col("u").alias("node"), F.col("p").alias("component"))
        else:
            moved = labels.join(up, F.col("component") == F.col("u"), "left")
            labels = materialise(moved.select("node", F.coalesce("p", "component").alias("component")), "labels")
        of_a, of_b = up.select(F.col("u").alias("a"), F.col("p").alias("pa")), up.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        edges = materialise(
            edges.join(of_a, "a").join(of_b, "b").filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(),
            "contracted",
        )
        if edges.isEmpty():
            return labels
