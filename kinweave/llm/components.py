"""Connected components of a graph given as a table of edges between long ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b); equal roots for connected nodes.

    Each round contracts every node into its smallest neighbour or itself and carries on with the edges left between
    different nodes, so the number of rounds is about the logarithm of the longest path for ids in no order. Each round
    is written to the shared folder. Edges from a node to itself only name it. Columns beside a and b are ignored."""
    first = stored(edges.select("a", "b").distinct(), "edges")
    roots = stored(first.select(F.col("a").alias("node")).union(first.select("b")).distinct().withColumn("root", F.col("node")), "roots")
    left = first.filter("a <> b")
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        to = stored(both.groupBy(F.col("a").alias("from")).agg(F.least(F.col("from"), F.min("b")).alias("to")), "to")
        roots = stored(roots.join(to, roots["root"] == to["from"], "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
        one, two = to.select(F.col("from").alias("a"), F.col("to").alias("x")), to.select(F.col("from").alias("b"), F.col("to").alias("y"))
        moved = left.join(one, "a").join(two, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        left = stored(moved.distinct(), "edges")
    return roots
