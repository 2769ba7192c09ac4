"""Connected components of a graph given by its edges, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b); the component is its smallest node.

    In a round each node joins the neighbour (or itself) that a hash ranks first, and the edges
    between what has been joined go on to the next round; a constant part of the nodes goes in
    each. All aggregations are minima, so a node with many edges is summed up before the
    shuffle. Rounds are materialised.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("rank"), F.col(c).alias("id"))
    current = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    labels = None
    while True:
        both = current.unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.min(rank("b")).alias("best"))
        joins = nearest.select(F.col("a").alias("node"), F.least(rank("a"), F.col("best"))["id"].alias("root"))
        joins = materialize(joins, "joins")
        if labels is None:
            labels = joins
        else:
            step = joins.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = materialize(labels.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "labels")
        of_a = joins.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
        of_b = joins.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
        left = current.join(of_a, "a").join(of_b, "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
        current = materialize(left.where("a <> b").distinct(), "edges")
        if current.isEmpty():
            break
    smallest = labels.groupBy("root").agg(F.min("node").alias("component"))
    return labels.join(smallest, "root").select("node", "component")
