"""Connected components by alternating large and small stars, all in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): of each node with an edge, the smallest node it reaches. ``edges`` has columns a and b of one type.

    In a round every node points its larger neighbours to its smallest one, then itself and
    its smaller ones. Nothing is collected at a node: its minimum is an aggregate, combined
    before the shuffle. It is written before it goes back by a join, so that either side of
    the join is an exchange of its own and Spark splits the edges of a hub over many tasks.
    Rounds go on until nothing changes; their number grows with the logarithm of the nodes.
    """
    edges = common.written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark, old = _mark(edges), None
    while mark[0] and mark != old:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = common.written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least", free=False)
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = common.written(large, "large", free=False)
        lower = common.written(large.groupBy("a").agg(F.min("b").alias("m")), "lower", free=False)
        small = large.join(lower, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = common.written(small.unionByName(lower.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
        for t in (edges, least, large, lower):
            common.release(t)
        edges, old, mark = new, mark, _mark(new)
    roots = edges.groupBy("a").agg(F.min("b").alias("root"))
    nodes = roots.select(F.col("a").alias("node"), "root")
    return nodes.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
