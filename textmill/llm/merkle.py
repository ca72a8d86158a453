"""Merkle manifest of a table: a hash tree of fan-out eight for each group of rows, and one over the groups.

A row's leaf is the SHA-256 of its fields, computed where the row is read; texts aren't shuffled. Leaves get their gapless
place in their group by a range partition: each partition is counted, and the counts before it are its offset, so a group that
holds a third of all rows is spread like any other. A task hashes `SPAN` = 8^`LEVELS` neighbouring leaves up to one node; the nodes are leaves of
the next table, until one is left in each group. The groups' roots are hashed the same way.

Proofs come back down these tables. A chunk of leaves meets the way from its top node to the root (one row), and the task
makes the chunk's SHA midstate tree: each parent keeps copies of its hash state before each of its slots, as do the parents on
the way to the root. A changed leaf is folded by resuming, level by level, the state before its slot with the
replacement and the siblings to its right only; what stands to its left is hashed once a parent, not once a fold.

Defined results: a null field counts as ``-``; a null group comes first; leaves of one id (null first) stand in the order of their
digests, and repeated rows are a leaf each; one leaf alone is its group's root, and one group's root alone is the root; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ._scratch import written

FAN, LEVELS = 8, 4
SPAN = FAN**LEVELS
NODE = "g string, pos long, n long, h string"
WAY = "g string, pos long, left array<string>, right array<string>, subroot string, root string"


def leaf_of(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each with its length before it."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with pos (from 0 in each group g) and n (rows of the group)."""
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange("g", *order, "tie")
    dealt = written(dealt.withColumn("part", F.spark_partition_id()), "merkle-dealt")
    counts = dealt.groupBy("part", "g").agg(F.count("*").alias("c"))
    before = W.partitionBy("g").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition of a group
    counts = counts.select("part", "g", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"), F.sum("c").over(W.partitionBy("g")).alias("n"))
    place = F.row_number().over(W.partitionBy("part", "g").orderBy(*order, "tie"))
    out = dealt.join(counts.hint("merge"), ["part", "g"]).withColumn("pos", F.col("offset") + place - 1)
    return out.drop("part", "offset", "tie")


def depth(n: int) -> int:
    """Levels that a chunk of a group of n nodes is hashed up."""
    d = 0
    while n > 1 and d < LEVELS:
        n, d = -(-n // FAN), d + 1
    return d


def midstates(leaves: list[bytes], levels: int) -> tuple[list[list[bytes]], list[list]]:
    """Digests of each level, and for each node but the top its parent's state before the node's slot."""
    digests, states = [leaves], []
    for _ in range(levels):
        below, above, held = digests[-1], [], []
        for i in range(0, len(below), FAN):
            parent = sha256()
            for child in below[i : i + FAN]:
                held.append(parent.copy())
                parent.update(child)
            above.append(parent.hexdigest().encode())
        digests.append(above)
        states.append(held)
    return digests, states


def _sorted(chunk: pa.Table) -> tuple[pa.Table, int]:
    return chunk.take(pa.array(np.argsort(chunk["pos"].to_numpy(), kind="stable"))), chunk["n"][0].as_py()


def _bytes(column: pa.ChunkedArray) -> list[bytes]:
    return [x.encode() for x in column.to_pylist()]


def _top(chunk: pa.Table) -> pa.Table:
    chunk, n = _sorted(chunk)
    digests, _ = midstates(_bytes(chunk["h"]), depth(n))
    return pa.table({"g": chunk["g"][:1], "pos": [chunk["pos"][0].as_py() // SPAN], "n": [-(-n // SPAN)], "h": [digests[-1][0].decode()]}, pa.schema([("g", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("h", pa.string())]))


def _chunked(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("chunk", F.floor(F.col("pos") / SPAN))


def climb(nodes: DataFrame) -> list[DataFrame]:
    """Tables of nodes from ``nodes`` (g, pos, n, h and more, written) up to one node in each group."""
    tables = [nodes]
    while (tables[-1].agg(F.max("n")).first()[0] or 0) > 1:
        up = _chunked(tables[-1]).select("g", "chunk", "pos", "n", "h").groupBy("g", "chunk").applyInArrow(_top, NODE)
        tables.append(written(up, "merkle-nodes"))
    return tables


def _siblings(level: list[bytes], i: int) -> tuple[bytes, bytes]:
    a = i - i % FAN
    return b"".join(level[a:i]), b"".join(level[i + 1 : a + FAN])


def _ways(chunk: pa.Table, way: pa.Table) -> pa.Table:
    """The way of each node of a chunk, from that of the chunk's top."""
    chunk, n = _sorted(chunk)
    d = depth(n)
    digests, _ = midstates(_bytes(chunk["h"]), d)
    up = [way[c][0].as_py() for c in ("left", "right")]
    both = [[_siblings(digests[k], i // FAN**k) for k in range(d)] for i in range(len(chunk))]
    sides = [[[s[x].decode() for s in b] + up[x] for b in both] for x in (0, 1)]
    m = len(chunk)
    strings = pa.list_(pa.string())
    return pa.table({"g": chunk["g"], "pos": chunk["pos"], "left": pa.array(sides[0], strings), "right": pa.array(sides[1], strings), "subroot": pa.array([way["subroot"][0].as_py()] * m, pa.string()), "root": pa.array([way["root"][0].as_py()] * m, pa.string())})


def _proofs(chunk: pa.Table, way: pa.Table) -> pa.Table:
    """Of each leaf of a chunk: digest of its siblings, and the root folded from its changed digest."""
    chunk, n = _sorted(chunk)
    d = depth(n)
    leaves = _bytes(chunk["h"])
    digests, states = midstates(leaves, d)
    lefts, rights = ([x.encode() for x in way[c][0].as_py()] for c in ("left", "right"))
    above = b"".join(a + b for a, b in zip(lefts, rights))
    ahead = [sha256(a) for a in lefts]
    root = way["root"][0].as_py()
    proofs, folded = [], []
    for i, (leaf, changed) in enumerate(zip(leaves, chunk["changed"].to_pylist())):
        proof, h = sha256(), changed.encode() if changed is not None else leaf
        for k in range(d):
            at = i // FAN**k
            left, right = _siblings(digests[k], at)
            proof.update(left + right)
            state = states[k][at].copy()
            state.update(h + right)
            h = state.hexdigest().encode()
        for state, right in zip(ahead, rights):
            state = state.copy()
            state.update(h + right)
            h = state.hexdigest().encode()
        proof.update(above)
        proofs.append(proof.hexdigest())
        folded.append(h.decode())
    m = len(chunk)
    return pa.table({"doc_id": chunk["doc_id"], "group": chunk["group"], "pos": chunk["pos"], "leaf": chunk["h"], "subroot": pa.array([way["subroot"][0].as_py()] * m, pa.string()), "root": pa.array([root] * m, pa.string()), "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string()), "verified": pa.array([f == root for f in folded], pa.bool_())})


def _down(nodes: DataFrame, ways: DataFrame, of, schema: str) -> DataFrame:
    """A chunk of nodes with the one row that leads on from its top; a chunk has `SPAN` rows at most."""
    return _chunked(nodes).groupBy("g", "chunk").cogroup(ways.withColumn("chunk", F.col("pos")).groupBy("g", "chunk")).applyInArrow(of, schema)


def _all_ways(tables: list[DataFrame], top: DataFrame) -> DataFrame:
    """Ways of the second table's nodes, or of the only one's, from those of the last one's."""
    ways = top
    for nodes in reversed(tables[1:-1]):
        ways = written(_down(nodes.select("g", "pos", "n", "h"), ways, _ways, WAY), "merkle-ways")
    return ways


def manifest(docs: DataFrame, fields: list[str], changed: Column | None = None, id_col: str = "doc_id", group_col: str = "lang", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, group, pos, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``changed`` is the text that a row turned out to have when it was checked, null where it is as it was; the
    root is folded from that text's leaf and the siblings of the manifest."""
    now = [F.col(f"`{f}`") for f in fields]
    leaf = leaf_of(now)
    other = F.lit(None).cast("string") if changed is None else F.when(changed.isNotNull(), leaf_of([changed if f == text_col else c for f, c in zip(fields, now)]))
    group = F.col(f"`{group_col}`").cast("string")
    rows = docs.select(F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("g"), group.alias("group"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), leaf.alias("h"), other.alias("changed"))
    tables = climb(written(numbered(rows, ["doc_id", "h"]), "merkle-leaves"))
    subroots = numbered(tables[-1].select(F.lit("").alias("g"), F.col("g").alias("group"), "h"), ["group"])
    above = climb(written(subroots, "merkle-subroots"))

    none = F.array().cast("array<string>")
    root = above[-1].select("g", "pos", none.alias("left"), none.alias("right"), F.lit(None).cast("string").alias("subroot"), F.col("h").alias("root"))
    ways = _all_ways(above, root)
    if len(above) > 1:
        ways = written(_down(above[0].select("g", "pos", "n", "h"), ways, _ways, WAY), "merkle-ways")
    groups = above[0].select("pos", F.col("group").alias("g"), F.col("h").alias("subroot"))
    top = written(ways.drop("g", "subroot").join(groups.hint("merge"), "pos").select("g", F.lit(0).cast("long").alias("pos"), "left", "right", "subroot", "root"), "merkle-groups")
    ways = _all_ways(tables, top)
    columns = "doc_id long, group string, pos long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _down(tables[0], ways, _proofs, columns)
