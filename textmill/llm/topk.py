"""Exact top-k inner products with a KD-tree for each shard.

Space is cut into at most ``cells`` cells by median splits of a bounded sample of the vectors. The
rows of a cell are dealt to shards of about ``shard_rows``. Each shard's tree is built by median
splits of its widest dimension and carries tight boxes; it is one binary value. Queries first meet
the tree of their own shard; the k-th score found there goes with them. They are then held against
the tight boxes of all cells, and only where a box may hold an equal or better score do they go on,
in blocks, to the trees of that cell. In a tree nodes are visited best bound first: the largest
inner product that any point of a box can have with the query; a box below the k-th score is left
out. A box that ties with it is not, as equal scores are ordered by id.

The sample decides only where the cuts are, never a result: boxes are those of all rows. What is
sent to every task are the cells' boxes, ``cells`` times the dimension. The work list has a row for
each block of queries and tree left, dealt evenly; no task holds more than one tree and one block.

Defined results: vectors that are null, empty or hold null, NaN or infinite components take no
part; vectors are compared within their dimension; a null id takes no part; repeated rows are
candidates each, spread over their cell's shards, and ask once; an id with several vectors asks with
each and gets the best of all answers; a query never finds its own id, and fewer than k candidates
give fewer rows; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ._scratch import written

EXACT = 1 << 52


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(data)))


def _small(points: np.ndarray) -> np.ndarray:
    """The same numbers in the narrowest kind that holds them."""
    most = int(np.abs(points).max(initial=0))
    return points.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def build_tree(ids: np.ndarray, points: np.ndarray, leaf: int) -> dict[str, np.ndarray]:
    """Nodes in order of making: low and high corners, children (or -1), rows [first, last)."""
    order = np.arange(len(ids))
    low, high, left, right, first, last = [], [], [], [], [], []

    def add(a: int, b: int) -> int:
        p = points[order[a:b]]
        low.append(p.min(axis=0)), high.append(p.max(axis=0))
        left.append(-1), right.append(-1), first.append(a), last.append(b)
        return len(low) - 1

    todo = [add(0, len(ids))]
    while todo:
        i = todo.pop()
        a, b = first[i], last[i]
        wide = int((high[i].astype(np.int64) - low[i]).argmax())
        if b - a <= leaf or high[i][wide] == low[i][wide]:
            continue
        mid = (a + b) // 2
        part = order[a:b]
        order[a:b] = part[np.argpartition(points[part, wide], mid - a)]
        left[i], right[i] = add(a, mid), add(mid, b)
        todo += [left[i], right[i]]
    return {"ids": ids[order], "points": points[order], "low": np.array(low), "high": np.array(high), "left": np.array(left), "right": np.array(right), "first": np.array(first), "last": np.array(last)}


def search(tree: dict[str, np.ndarray], qids: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, scores) of the best k of each query in the tree among those with a score of ``least``
    or more, best first, ties to the smaller id."""
    big = float(np.abs(queries.astype(np.float64)).max(initial=0)) * float(np.abs(tree["points"].astype(np.float64)).max(initial=0)) * max(1, queries.shape[1])
    kind = np.float64 if big < EXACT else np.int64  # doubles are exact up to there, and faster
    queries, points = queries.astype(kind), tree["points"].astype(kind)
    low, high = tree["low"].astype(kind), tree["high"].astype(kind)
    bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    left, right, first, last = (tree[x].tolist() for x in ("left", "right", "first", "last"))
    out = []
    for q in range(len(qids)):
        own, kth = bounds[q], least[q]
        ids, scores = np.zeros(0, np.int64), np.zeros(0, kind)
        heap = [(-own[0], 0)]
        while heap and -heap[0][0] >= kth:
            node = heapq.heappop(heap)[1]
            if left[node] >= 0:
                for child in (left[node], right[node]):
                    if own[child] >= kth:
                        heapq.heappush(heap, (-own[child], child))
                continue
            a, b = first[node], last[node]
            score = points[a:b] @ queries[q]
            good = score >= kth
            near = tree["ids"][a:b][good]
            other = near != qids[q]
            if other.any():
                ids, scores = np.concatenate((ids, near[other])), np.concatenate((scores, score[good][other]))
                if len(ids) > k:
                    best = np.lexsort((ids, -scores))[:k]
                    ids, scores = ids[best], scores[best]
                if len(ids) == k:
                    kth = max(kth, scores.min())
        best = np.lexsort((ids, -scores))
        out.append((ids[best], scores[best].astype(np.int64)))
    return out


def _rows(qids: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    n = [len(f[0]) for f in found]
    flat = lambda i: np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, n), pa.int64()), pa.array(flat(0), pa.int64()), pa.array(flat(1), pa.int64())], ["query_id", "vec_id", "score"])


@dataclass
class Cuts:
    """Median splits of a sample: inner nodes have an axis, leaves the number of their cell."""

    axis: np.ndarray
    at: np.ndarray
    down: np.ndarray  # the lower child; the upper one follows it
    cell: np.ndarray

    @staticmethod
    def of(points: np.ndarray, cells: int) -> Cuts:
        axis, at, down, held = [-1], [0], [-1], {0: points}
        while len(held) < cells:
            node = max((n for n in held if down[n] == -1), key=lambda n: len(held[n]), default=None)
            if node is None or len(held[node]) < 2:
                break
            p = held[node]
            wide = int((p.max(axis=0) - p.min(axis=0)).argmax())
            middle = int(np.sort(p[:, wide])[(len(p) - 1) // 2])
            low = p[:, wide] <= middle
            if low.all():
                down[node] = -2  # one point only; no cut
                continue
            axis[node], at[node], down[node] = wide, middle, len(axis)
            held[len(axis)], held[len(axis) + 1] = p[low], p[~low]
            axis, at, down = axis + [-1, -1], at + [0, 0], down + [-1, -1]
            del held[node]
        leaves = [n for n in range(len(axis)) if axis[n] < 0]
        cell = np.full(len(axis), -1)
        cell[leaves] = np.arange(len(leaves))
        return Cuts(np.array(axis), np.array(at), np.array(down), cell)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        while True:
            inner = np.flatnonzero(self.axis[node] >= 0)
            if not len(inner):
                return self.cell[node]
            n = node[inner]
            node[inner] = self.down[n] + (points[inner, self.axis[n]] > self.at[n])


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.array(column.flatten()).reshape(-1, dim)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, shard_rows: int = 8192, block_rows: int = 1024, leaf: int = 128, sample: int = 8192, cells: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Queries are the rows whose id is divisible by ``every``; components are floor(scale * x).
    Returns query_id, rank (from 1), vec_id, score."""
    v = F.col("v")
    valid = F.col("vec_id").isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter(valid)
    rows = rows.select("vec_id", F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("v"), F.size(v).alias("dim"))
    total = rows.count()
    picked = rows.select("dim", "v", F.xxhash64("vec_id", "v").alias("h")).orderBy("h").limit(sample).toArrow()
    cuts: dict[int, Cuts] = {}
    for dim in set(picked.column("dim").to_pylist()):
        own = picked.filter(pc.equal(picked.column("dim"), dim))
        cuts[dim] = Cuts.of(_matrix(own.column("v"), dim), min(cells, max(1, total * own.num_rows // (picked.num_rows * shard_rows))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for b in batches:
            dims = b.column(2).to_numpy()
            cell = np.zeros(len(dims), np.int32)
            for dim in set(dims.tolist()) & cuts.keys():
                which = np.flatnonzero(dims == dim)
                cell[which] = cuts[dim](_matrix(b.column(1).take(pa.array(which)), dim))
            deal = (b.column(0).to_numpy().astype(np.uint64) + np.arange(seen, seen + len(dims), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1)
            seen += len(dims)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(deal.astype(np.int64))], ["vec_id", "v", "dim", "cell", "deal"])

    def tree(key: tuple, t: pa.Table) -> pa.Table:
        dim, cell, shard = (x.as_py() for x in key)
        points = _matrix(t.column("v"), dim)
        data = _pack(**build_tree(np.array(t.column("vec_id")), _small(points), leaf))
        box = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (points.min(axis=0), points.max(axis=0))]
        return pa.table([pa.array([dim], pa.int32()), pa.array([cell], pa.int32()), pa.array([shard], pa.int64()), pa.array([data], pa.binary()), *box], ["dim", "cell", "shard", "tree", "low", "high"])

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        dim, cell, block = (x.as_py() for x in key)
        more = {x: np.array(t.column(x)) for x in ("kth", "home") if x in t.column_names}
        data = _pack(ids=np.array(t.column("vec_id")), points=_small(_matrix(t.column("v"), dim)), **more)
        return pa.table([pa.array([dim], pa.int32()), pa.array([cell], pa.int32()), pa.array([block], pa.int64()), pa.array([data], pa.binary())], ["dim", "cell", "block", "asked"])

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, q in zip(*(c.to_pylist() for c in b.columns)):
                q = _unpack(q)
                yield _rows(q["ids"], search(_unpack(t), q["ids"], q["points"], k, np.full(len(q["ids"]), -np.inf)))

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, t, q in zip(*(c.to_pylist() for c in b.columns)):
                q = _unpack(q)
                least = np.where(q["home"] == shard, np.inf, q["kth"])  # a query has been to its own shard
                yield _rows(q["ids"], search(_unpack(t), q["ids"], q["points"], k, least))

    placed = written(rows.mapInArrow(place, "vec_id long, v array<long>, dim int, cell int, deal long"), "placed")
    sizes = placed.groupBy("dim", "cell").agg(F.count("*").alias("n")).filter(F.col("n") > shard_rows)  # a row for shard_rows rows at most
    subs = F.coalesce(F.ceil(F.col("n") / shard_rows), F.lit(1)).cast("long")
    dealt = placed.join(F.broadcast(sizes), ["dim", "cell"], "left").select("vec_id", "v", "dim", "cell", F.pmod("deal", subs).alias("shard"))
    trees = written(dealt.groupBy("dim", "cell", "shard").applyInArrow(tree, "dim int, cell int, shard long, tree binary, low array<long>, high array<long>"), "trees")
    asked = dealt.filter(F.pmod(F.col("vec_id"), F.lit(every)) == 0).groupBy("vec_id", "v", "dim").agg(F.min(F.struct("cell", "shard")).alias("own"))
    asked = written(asked.select("vec_id", "v", "dim", "own.cell", "own.shard"), "queries")
    packed = "dim int, cell int, block long, asked binary"
    own = asked.withColumnRenamed("shard", "block").groupBy("dim", "cell", "block").applyInArrow(pack, packed)
    begun = own.withColumnRenamed("block", "shard").hint("merge").join(trees.select("dim", "cell", "shard", "tree"), ["dim", "cell", "shard"]).select("tree", "asked")
    found_schema = "query_id long, vec_id long, score long"
    begun = written(begun.mapInArrow(home, found_schema), "begun")
    kth = begun.groupBy("query_id").agg(F.min("score").cast("double").alias("low"), F.count("*").alias("n"))
    bound = F.when(F.col("n") >= k, F.col("low")).otherwise(F.lit(float("-inf"))).alias("kth")
    known = asked.hint("merge").join(kth, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "v", "dim", "cell", "shard", bound)
    going = written(known.mapInArrow(_surviving(_boxes(trees, cuts)), "vec_id long, v array<long>, dim int, kth double, cell int, home long"), "going")
    blocks = going.groupBy("dim", "cell").agg(F.ceil(F.count("*") / block_rows).alias("blocks"))  # a row for a cell
    blocked = going.join(F.broadcast(blocks), ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks")))
    blocked = written(blocked.groupBy("dim", "cell", "block").applyInArrow(pack, packed), "asked")
    # the work list, a row for each block and tree of a cell, is dealt out evenly before trees and blocks are fetched
    salts = 16
    left = blocked.select("dim", "cell", "block", F.pmod("block", F.lit(salts)).cast("int").alias("salt"))
    right = trees.select("dim", "cell", "shard", F.explode(F.array(*[F.lit(i) for i in range(salts)])).alias("salt"))
    work = left.hint("merge").join(right, ["dim", "cell", "salt"]).drop("salt")
    work = work.hint("merge").join(blocked, ["dim", "cell", "block"]).hint("merge").join(trees, ["dim", "cell", "shard"])
    found = begun.unionByName(work.select("shard", "tree", "asked").mapInArrow(rest, found_schema))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _boxes(trees: DataFrame, cuts: dict[int, Cuts]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Cells, low and high corners of every dimension that was cut; as many numbers as cells times twice the dimension."""
    many = [dim for dim, c in cuts.items() if len(c.axis) > 1]
    if not many:
        return {}
    corners = trees.filter(F.col("dim").isin(many)).select("dim", "cell", F.posexplode(F.arrays_zip("low", "high")).alias("p", "x"))
    t = corners.groupBy("dim", "cell", "p").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high")).toArrow().to_pandas()
    out = {}
    for dim, part in t.sort_values(["dim", "cell", "p"]).groupby("dim"):
        out[int(dim)] = (part["cell"].to_numpy()[::dim], part["low"].to_numpy().reshape(-1, dim), part["high"].to_numpy().reshape(-1, dim))
    return out


def _surviving(boxes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """A row for each query and cell whose box may hold a score of the query's k-th one or more; cells
    of dimensions that weren't cut are one. ``home`` is the query's own shard in its own cell, else -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, own, shard, kth = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4, 5))
            row, cell = [], []
            for dim in set(dims.tolist()):
                which = np.flatnonzero(dims == dim)
                if dim not in boxes:
                    row.append(which), cell.append(np.zeros(len(which), np.int64))
                    continue
                cells, low, high = boxes[dim]
                for part in np.array_split(which, max(1, len(which) * len(cells) // (1 << 22))):
                    q = _matrix(b.column(1).take(pa.array(part)), dim).astype(np.float64)
                    best = np.maximum(q, 0) @ high.T.astype(np.float64) + np.minimum(q, 0) @ low.T.astype(np.float64)
                    i, c = np.nonzero(best + np.abs(best) * 1e-9 + 1 >= kth[part][:, None])
                    row.append(part[i]), cell.append(cells[c])
            row, cell = np.concatenate(row) if row else np.zeros(0, np.int64), np.concatenate(cell) if cell else np.zeros(0, np.int64)
            for i in range(0, len(row), 4096):
                r, c = row[i : i + 4096], cell[i : i + 4096]
                picked = b.take(pa.array(r))
                yield pa.RecordBatch.from_arrays([picked.column(0), picked.column(1), picked.column(2), picked.column(5), pa.array(c.astype(np.int32)), pa.array(np.where(c == own[r], shard[r], -1))], ["vec_id", "v", "dim", "kth", "cell", "home"])

    return run
