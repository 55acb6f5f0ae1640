"""Connected components by hooking and jumping over parent pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.shared import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (x, y): the component's smallest node.

    Each node points to a parent, itself at first.  In a round a node and its parent turn to the smallest grandparent
    among the node's neighbours, if that is smaller, and each node to its own grandparent.  Pointers halve their way
    to the root, so a chain of n nodes takes about log n rounds, each with a few aggregations by node.
    """
    both = cut(edges.select("x", "y").union(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    at = cut(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("p")).select("node", F.least("node", "p").alias("p")))
    while True:
        up = cut(at.join(at.select(F.col("node").alias("p"), F.col("p").alias("g")), "p").select("node", "p", "g"))
        near = both.join(up.select(F.col("node").alias("y"), "g"), "y").groupBy(F.col("x").alias("node")).agg(F.min("g").alias("m"))
        known = up.join(near, "node")
        turns = F.explode(F.array(F.struct(F.col("p").alias("node"), F.col("m").alias("p")), F.struct(F.col("node").alias("node"), F.least("p", "g", "m").alias("p"))))
        new = cut(known.select(turns.alias("t")).select("t.node", "t.p").groupBy("node").agg(F.min("p").alias("p")))
        same = new.join(at.withColumnRenamed("p", "q"), "node").where("p <> q").isEmpty()
        at = new
        if same:
            return at.withColumnRenamed("p", "root")
