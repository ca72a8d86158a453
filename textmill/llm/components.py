"""Connected components of an edge table by alternating stars (large star, small star).

Both steps are a partial minimum per node and a join back, so a node with very many edges is
never gathered; each round is written to the shared folder. The table never leaves Spark: the
driver sees two numbers a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges(a, b), a > b. Links every neighbour to the node's smallest one."""
    if large:  # of u: v > u, and the smallest of all neighbours and u
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "u")
        far = both.filter("b > a").hint("merge").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # of u: v < u, all linked to the smallest
        low = edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        far = edges.hint("merge").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        far = far.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return far.filter("a > b").distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """edges(a long, b long) -> (node, root): root is the smallest node reachable. Nodes without
    an edge aren't returned; loops and repeated or reversed edges don't matter."""
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges")
    sign = None
    for _ in range(most):
        edges = written(_star(_star(edges, True), False), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == sign:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        sign = tuple(now)
    raise RuntimeError("components: no fixed point")
