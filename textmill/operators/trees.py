"""Hierarchies of any depth: pre-order position, subtree size, depth and full path by pointer doubling.

The Euler tour of a forest is a list: a node is entered, then its children's tours follow, then it is left. Ranking
that list by pointer doubling gives positions, sizes and depths in as many rounds as the list's length has binary digits; each
round is one join with a row for each element, so chains as deep as the scene is long need no recursion.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graphs as G
from .scratch import written
from .spread import carried


def _to_the_end(links: DataFrame, key: str, to: str, joined: dict, name: str) -> DataFrame:
    """Pointer doubling over ``to`` until it is null everywhere or what is left goes round in circles. ``joined`` makes the new
    value of each column from the row's own and that of the row it points to (prefix ``far_``)."""
    before = None
    at = written(links, name)
    while (left := at.filter(F.col(to).isNotNull()).count()) and left != before:
        before = left
        far = at.select(*[F.col(c).alias(f"far_{c}") for c in at.columns])
        both = at.hint("merge").join(far, F.col(to) == F.col(f"far_{key}"), "left")
        known = F.col(f"far_{key}").isNotNull()
        at = written(both.select(key, F.col(f"far_{to}").alias(to), *[F.when(known, of).otherwise(F.col(c)).alias(c) for c, of in joined.items()]), name)
    return at


def _walked(table: pa.Table) -> pa.Table:
    """The rows of ``hierarchy`` for a group of whole scenes; those in or under circles with their parents and nothing else."""
    scenes: dict = {}
    for path, line, name, parent in zip(*(table[c].to_pylist() for c in ("path", "line_no", "name", "parent"))):
        known = scenes.setdefault(path, {})
        if name not in known or line is not None and (known[name][0] is None or line > known[name][0]):
            known[name] = (line, None if parent == "." or line is None else parent)
    place = lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")  # noqa: E731  # nulls first
    out = []
    for path, known in scenes.items():
        below: dict = {}
        for name, (line, parent) in known.items():
            below.setdefault(parent, []).append((line, name))
        for rows in below.values():
            rows.sort(key=place)
        roots = sorted(below.get(None, []) + [(rows[0][0], p) for p, rows in below.items() if p is not None and p not in known], key=place)
        left, rows, ends = [(name, None, 0) for _, name in reversed(roots)], [], []
        while left:
            name, above, depth = left.pop()
            while ends and ends[-1][1] >= depth:
                rows[ends.pop()[0]][-1] = len(rows)
            full = "/".join(x for x in (above, name) if x is not None) if (above, name) != (None, None) else None
            if name in known:
                ends.append((len(rows), depth))
                rows.append([path, name, None, full, depth, len(rows), 0])
            left += [(n, full, depth + 1) for _, n in reversed(below.get(name, []) if name is not None else [])]
        for at, _ in ends:
            rows[at][-1] = len(rows)
        met = {r[1] for r in rows}
        out += [(*r[:-1], r[-1] - r[-2]) for r in rows] + [(path, name, parent, None, None, None, None) for name, (_, parent) in known.items() if name not in met]
    kinds = [pa.string()] * 4 + [pa.int64()] * 3
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 7, kinds)], names=["path", "name", "parent", "full_path", "depth", "position", "size"])


def hierarchy(nodes: DataFrame, most: int = 2_000, each: int = 50_000) -> DataFrame:
    """nodes(path, line_no, name, parent) -> (path, name, full_path, depth, position, size), at any depth. A parent is a name of
    the same scene ("." and null: none); the last node of a name counts; siblings stand in the order of their lines. A parent
    that the scene lacks stands in the full path and counts for the depth, where its first child stands, but has nothing above it
    and no position. Nodes of a circle, and those below, stand under each other once and have no position and size. Scenes of ``most``
    nodes or fewer are walked in groups of about ``each`` nodes, as a scene's paths may take the square of its nodes; larger ones by pointer doubling."""
    nodes = written(nodes.select("path", "line_no", "name", "parent").filter("path IS NOT NULL"), "tree-lines")
    large = written(nodes.groupBy("path").count().filter(F.col("count") > most).select("path"), "tree-large")
    some = not large.isEmpty()
    few = nodes.hint("merge").join(large, "path", "left_anti") if some else nodes
    groups = max(1, -(-nodes.count() // each))
    dealt = few.withColumn("g", F.pmod(F.xxhash64("path"), F.lit(groups)).cast("int")).repartition(groups, "g")
    walked = written(dealt.groupBy("g").applyInArrow(_walked, "path string, name string, parent string, full_path string, depth long, position long, size long"), "tree-walked")
    out, round_ = walked.filter("position IS NOT NULL").drop("parent"), walked.filter("position IS NULL").select("path", "name", "parent")
    if not round_.isEmpty():
        out = out.unionByName(_with_circles(round_))
    return out.unionByName(_doubled(nodes.hint("merge").join(large, "path", "left_semi"))) if some else out


def _with_circles(nodes: DataFrame) -> DataFrame:
    none = F.lit(None).cast("long")
    return _circles(nodes).select("path", "name", "full_path", "depth", none.alias("position"), none.alias("size"))


def _doubled(nodes: DataFrame) -> DataFrame:
    """``hierarchy`` of scenes of any number of nodes."""
    last = nodes.groupBy("path", "name").agg(F.max_by(F.struct("parent", "line_no"), "line_no").alias("n")).select("path", "name", F.when(F.col("n.parent") != ".", F.col("n.parent")).alias("parent"), F.col("n.line_no").alias("line_no"), F.lit(1).alias("real"))
    children = last.filter("parent IS NOT NULL").groupBy("path", F.col("parent").alias("name")).agg(F.min("line_no").alias("line_no"))
    absent = children.hint("merge").join(last, ["path", "name"], "left_anti").select("path", "name", F.lit(None).cast("string").alias("parent"), "line_no", F.lit(0).alias("real"))
    every = written(last.unionByName(absent).withColumn("id", F.monotonically_increasing_id()), "tree-nodes")
    named = every.select("path", F.col("name").alias("parent"), F.col("id").alias("up"))
    placed = every.hint("merge").join(named, ["path", "parent"], "left").select("path", "name", "parent", "line_no", "real", "id", "up")
    # the next sibling is what came last from the other end
    placed = written(carried(placed, ["path", "up"], [F.desc("line_no"), F.desc("name")], {"sibling": F.col("id")}), "tree-links")
    first = placed.filter("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(F.min_by("id", F.struct("line_no", "name")).alias("child"))
    tour = placed.hint("merge").join(first, "id", "left")
    enter = tour.select((F.col("id") * 2).alias("el"), F.coalesce(F.col("child") * 2, F.col("id") * 2 + 1).alias("to"), F.col("real").cast("long").alias("n"), F.lit(1).cast("long").alias("d"))
    leave = tour.select((F.col("id") * 2 + 1).alias("el"), F.coalesce(F.col("sibling") * 2, F.col("up") * 2 + 1).alias("to"), F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("d"))
    ranked = _to_the_end(enter.unionByName(leave), "el", "to", {"n": F.col("n") + F.col("far_n"), "d": F.col("d") + F.col("far_d")}, "tree-tour").filter("to IS NULL")
    # what an element counts is what comes from it to its list's end
    both = ranked.groupBy(F.floor(F.col("el") / 2).alias("id")).agg(F.max(F.when(F.col("el") % 2 == 0, F.col("n"))).alias("n"), F.max(F.when(F.col("el") % 2 == 1, F.col("n"))).alias("after"), F.max(F.when(F.col("el") % 2 == 0, -F.col("d"))).alias("depth"))
    known = written(placed.hint("merge").join(both, "id"), "tree-ranks")
    total = known.groupBy("path").agg(F.max("n").alias("total"))
    known = known.hint("merge").join(total, "path").select("id", "path", "name", "real", "up", "depth", (F.col("total") - F.col("n")).alias("position"), (F.col("n") - F.col("after")).alias("size"))
    steps = _to_the_end(known.select("id", "up", F.col("name").alias("full_path")), "id", "up", {"full_path": F.concat_ws("/", "far_full_path", "full_path")}, "tree-paths")
    out = known.filter("real = 1").hint("merge").join(steps.select("id", "full_path"), "id").select("path", "name", "full_path", "depth", "position", "size")
    round_ = placed.hint("merge").join(both, "id", "left_anti").select("path", "name", "parent")
    return out.unionByName(_with_circles(written(round_, "tree-circles")))


def _circles(nodes: DataFrame) -> DataFrame:
    """(path, name, full_path, depth) of nodes in or under circles, by what leads to them."""
    key = lambda c: F.struct("path", F.col(c).alias("name"))
    links = nodes.select(key("parent").alias("src"), key("name").alias("dst"))
    above = G.reachable(links, links.select(F.col("dst").alias("node"))).filter("start <> node")
    steps = F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("depth", F.col("node.name").alias("name"))))), lambda x: x["name"])
    trail = above.groupBy("start").agg(steps.alias("trail"), F.count("*").alias("depth")).select("start.path", "start.name", "trail", "depth")
    out = nodes.hint("merge").join(trail, ["path", "name"], "left")
    full = F.array_join(F.concat(F.coalesce("trail", F.array().cast("array<string>")), F.array("name")), "/")
    return out.select("path", "name", full.alias("full_path"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))


def below(tree: DataFrame, starts: DataFrame) -> DataFrame:
    """(path, start, name, depth, position): the pre-order traversal from each named node of starts(path, name), itself
    first, both counted from it."""
    s = starts.select("path", "name").distinct().hint("merge").join(tree, ["path", "name"]).select("path", F.col("name").alias("start"), F.col("depth").alias("d"), F.col("position").alias("a"), F.col("size").alias("s"))
    met = tree.hint("merge").join(s, "path").filter("position >= a AND position < a + s")
    return met.select("path", "start", "name", (F.col("depth") - F.col("d")).alias("depth"), (F.col("position") - F.col("a")).alias("position"))
