"""Dependency graphs as edge tables: impact, cycles, most depended on."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written


def reachable(edges: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """edges(src, dst), starts(node) -> (start, node, depth) for every node that can be reached over
    reversed edges: who depends on the start, and over how many steps at least. Each round joins the
    frontier only, drops what was seen, and is written out. Rounds go on until the
    frontier is empty; if ``most`` rounds are given and don't suffice, that is an error."""
    spark = edges.sparkSession
    back = edges.select(F.col("dst").alias("node"), F.col("src").alias("next")).distinct()
    front = starts.select(F.col("node").alias("start"), "node").distinct()
    seen = None
    for depth in count(1):
        step = front.hint("merge").join(back, "node").select("start", F.col("next").alias("node")).distinct()
        if seen is not None:
            step = step.hint("merge").join(seen, ["start", "node"], "left_anti")
        step = written(step, "graph-step")
        if step.isEmpty():
            break
        if most is not None and depth > most:
            raise RuntimeError(f"reachable: the frontier isn't empty after {most} rounds")
        found = step.withColumn("depth", F.lit(depth))
        seen = found if seen is None else written(seen.unionByName(found), "graph-seen")
        front = step
    return seen if seen is not None else spark.createDataFrame([], starts.select(F.col("node").alias("start"), "node").withColumn("depth", F.lit(0)).schema)


def _highest(edges: DataFrame) -> DataFrame:
    """edges(src, dst) -> (node, top): the greatest label of the nodes that lead to a node, itself included.

    Labels are hashes with the node behind them. Each round a node takes the greatest label of its
    predecessors, then the label that this label's own node has: it leads there too. As hashes stand in
    no order along the edges, that takes some dozen rounds on rings and chains of any length; a round
    holds a row for each node and each edge."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    at = written(nodes.withColumn("top", F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("v"))), "graph-labels")
    while True:
        heard = edges.hint("merge").join(at.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "top", F.lit(False).alias("own"))
        step = at.select("node", "top", F.lit(True).alias("own")).unionByName(heard)
        step = step.groupBy("node").agg(F.max("top").alias("top"), F.max(F.when(F.col("own"), F.col("top"))).alias("before"))
        ahead = at.select(F.col("node").alias("v"), F.col("top").alias("ahead"))
        step = step.withColumn("v", F.col("top.v")).hint("merge").join(ahead, "v").select("node", F.greatest("top", "ahead").alias("top"), "before")
        step = written(step, "graph-labels")
        at = step.select("node", "top")
        if step.filter("top <> before").isEmpty():
            return at


def _trimmed(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """Without edges at nodes that nothing leads to or that lead nowhere; a few rounds, as this only saves work."""
    for _ in range(rounds):
        edges = edges.hint("merge").join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").hint("merge").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        edges = written(edges, "graph-live")
    return edges


def strong_components(edges: DataFrame) -> DataFrame:
    """edges(src, dst) -> (node, root) of the nodes in strongly connected components of two nodes or more, by colouring.

    A node's colour is the greatest label that leads to it. Inside a colour, the nodes that lead back to its label's node are one
    component: the same search on the reversed edges finds them. They and all edges between colours go, and the rest is coloured again."""
    live, found = written(edges.filter("src <> dst").select("src", "dst").distinct(), "graph-live"), []
    while not (live := _trimmed(live)).isEmpty():
        down = _highest(live)
        both = live.hint("merge").join(down.select(F.col("node").alias("src"), F.col("top").alias("a")), "src").hint("merge").join(down.select(F.col("node").alias("dst"), F.col("top").alias("b")), "dst")
        inside = written(both.filter("a = b").select("src", "dst", "a"), "graph-inside")
        up = _highest(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        colours = written(down.hint("merge").join(up.withColumnRenamed("top", "back"), "node"), "graph-colours")
        found.append(colours.filter("top = back").select("node", F.col("top.v").alias("root")))
        # of two nodes of one component neither is done, and both have the same colour in both directions
        rest = colours.filter("top <> back").select("node", "back")
        live = inside.hint("merge").join(rest.select(F.col("node").alias("src"), F.col("back").alias("p")), "src").hint("merge").join(rest.select(F.col("node").alias("dst"), F.col("back").alias("q")), "dst")
        live = written(live.filter("p = q").select("src", "dst"), "graph-live")
    kind = edges.schema["src"].dataType.simpleString()
    return reduce(DataFrame.unionByName, found) if found else edges.sparkSession.createDataFrame([], f"node {kind}, root {kind}")


def condensed(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph of components: its edges (src, dst) without loops, the members (node, root) of components of two or more
    nodes, and (root, size, cyclic) of every component with a circle; what is in none stands for itself."""
    members = written(strong_components(edges), "graph-members")
    loops = edges.filter("src = dst").select(F.col("src").alias("node")).distinct()
    sizes = members.groupBy("root").agg(F.count("*").alias("size")).unionByName(loops.hint("merge").join(members, "node", "left_anti").select(F.col("node").alias("root"), F.lit(1).cast("long").alias("size")))
    links = edges.select("src", "dst")
    for side in ("src", "dst"):
        links = links.hint("merge").join(members.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root")), side, "left")
    links = links.select(F.coalesce("src_root", "src").alias("src"), F.coalesce("dst_root", "dst").alias("dst")).filter("src <> dst").distinct()
    return written(links, "graph-condensed"), members, written(sizes, "graph-sizes")


def impact(edges: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """Per start: dependents, direct ones, risk HIGH over 5, MEDIUM over 2, else LOW. Dependents are counted over
    the components of the graph, so a circle is one row however many nodes it has; a start in a circle depends on itself."""
    links, members, sizes = condensed(edges)
    asked = starts.select(F.col("node").alias("start")).distinct()
    asked = written(asked.hint("merge").join(members.select(F.col("node").alias("start"), "root"), "start", "left").select("start", F.coalesce("root", "start").alias("root")), "graph-asked")
    above = reachable(links, asked.select(F.col("root").alias("node")).distinct(), most)
    above = above.hint("merge").join(sizes.withColumnRenamed("root", "node"), "node", "left").groupBy(F.col("start").alias("root")).agg(F.sum(F.coalesce("size", F.lit(1))).alias("above"))
    direct = edges.select("src", F.col("dst").alias("start")).distinct().groupBy("start").agg(F.count("*").alias("direct"))
    out = asked.hint("merge").join(above, "root", "left").hint("merge").join(sizes, "root", "left").hint("merge").join(direct, "start", "left").na.fill(0)
    n = F.col("above") + F.col("size")
    return out.select("start", n.alias("dependents"), "direct", F.when(n > 5, "HIGH").when(n > 2, "MEDIUM").otherwise("LOW").alias("risk"))


def cyclic(edges: DataFrame) -> DataFrame:
    """Nodes that can reach themselves: members of strongly connected components, and nodes with an edge to themselves."""
    loops = edges.filter("src = dst").select(F.col("src").alias("node"))
    return strong_components(edges).select("node").unionByName(loops).distinct()


def stats(files: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """files(path), edges(src, dst) -> one row: files, scripts, scenes, edges, cycles (components with a circle), and the ``k``
    most depended on as an array of (path, dependents)."""
    sizes = condensed(edges.select("src", "dst").distinct())[2].agg(F.count("*").alias("cycles"))
    ends = lambda e: F.count_if(F.col("path").endswith(e))
    n = files.select("path").distinct().agg(F.count("*").alias("files"), ends(".gd").alias("scripts"), ends(".tscn").alias("scenes"))
    m = edges.select("src", "dst").distinct().agg(F.count("*").alias("edges"))
    top = most_depended_on(edges, k).agg(F.array_sort(F.collect_list(F.struct((-F.col("dependents")).alias("n"), F.col("dst").alias("path")))).alias("top"))
    top = top.select(F.transform("top", lambda x: F.struct(x["path"].alias("path"), (-x["n"]).alias("dependents"))).alias("most_depended_on"))
    return n.crossJoin(m).crossJoin(sizes).crossJoin(top)  # one row each


def most_depended_on(edges: DataFrame, k: int = 5) -> DataFrame:
    return edges.groupBy("dst").agg(F.countDistinct("src").alias("dependents")).orderBy(F.desc("dependents"), "dst").limit(k)
