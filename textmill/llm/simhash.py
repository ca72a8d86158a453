"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, then Hamming distance.

Fingerprints of 64 bits are made in Arrow batches. Rows with one fingerprint are one node. The
64 bits are cut into ``m`` blocks; two fingerprints within ``k`` bits agree on ``m - k`` blocks
at least, so one row for each choice of ``m - k`` blocks makes every close pair meet; ``m`` grows
with the number of fingerprints so that chance meetings per row stay bounded.

First every fingerprint is held against the smallest one of each bucket (a star). What is then one
component needs no more comparing, so only pairs across components are still looked at, and of those
only with the bucket's main component on one side at most. Every link between different components
is found, which is all that components need. A bucket in which more than ``DENSE`` fingerprints stand
outside its main component is not expanded into pairs: it is cut again by the same lemma on the bits
its choice left out, until its parts are small. That ends, as fingerprints are distinct: n of them
vary in log2(n) bits at least, and each cut takes half of the bits left.

Defined results: a null text has no words, like an empty one: fingerprint zero, linked like any
other; repeated rows share their fingerprint; a null id is never a component's id unless the
component has no other; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations
from math import ceil, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from xxhash import xxh3_128_digest, xxh64_intdigest

from ._scratch import written
from ._text import slices
from .components import components

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_STEP = 1 << 16
DENSE = 1024  # fingerprints of one bucket outside its main component that are compared as they stand
ELEMENTS, NODES = 1_000_000, 1_000  # of a block of sets compared inside a task
LOW = int(0.4 * 2**64)  # hashes below it are ordered by how many sets hold them, see first_elements


def simhash(data: bytes, size: int) -> int:
    """Fingerprint of UTF-8 text over its shingles of ``size`` words."""
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - size + 1)
    begins, ends = begins[:n].tolist(), (ends[-n:]).tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _STEP):
        h = np.array([xxh64_intdigest(joined[b:e], 42) for b, e in zip(begins[at : at + _STEP], ends[at : at + _STEP])], np.uint64)
        octets = h.astype("<u8").view(np.uint8).reshape(-1, 8)
        for i in range(8):
            counts[8 * i : 8 * i + 8] += np.bincount(octets[:, i], minlength=256) @ _BITS
    bits = (counts * 2 > n).astype(np.uint64)
    return int((bits << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def _fingerprints(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for b in batches:
            for part in slices(b, 1):
                fps = np.array([simhash(t or b"", size) for t in part.column(1).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, size: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) for every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(_fingerprints(size), "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _choices(bits: list[int], m: int, k: int) -> list[int]:
    """Masks of all choices of m - k from m blocks of the given bits."""
    cuts = [len(bits) * i // m for i in range(m + 1)]
    blocks = [sum(1 << b for b in bits[x:y]) for x, y in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(blocks, m - k)]


def block_masks(n: int, k: int) -> list[int]:
    """Masks of all choices of m - k from m blocks, as signed longs; the smallest m for which a
    fingerprint meets one other by chance in each choice at most."""
    for m in range(k + 2, 17):
        cuts = [64 * i // m for i in range(m + 1)]
        if n < 1 << min(sum(w) for w in combinations(sorted(b - a for a, b in zip(cuts, cuts[1:])), m - k)):
            break
    return [_signed(x) for x in _choices(list(range(64)), m, k)]


def finer_masks(mask: int, k: int) -> list[int]:
    """``mask`` with half of the bits it leaves out, in every choice such that two fingerprints that
    agree on it and are within ``k`` bits agree on one of them."""
    mask &= (1 << 64) - 1
    left = [b for b in range(64) if not mask >> b & 1]
    m = min(2 * k, len(left))
    return [_signed(mask | x) for x in _choices(left, m, k)] if m > k else [_signed(mask)]


def links(cells: DataFrame, k: int, finer: Callable[[int], list[int]] | None = None) -> DataFrame:
    """cells(c, v, id, f): a row for each node and block choice -> (id, root) for nodes with a link;
    see the module's text. Nodes of a cell link if f differs in ``k`` bits at most. Where cells are
    masks of f and what f holds there, ``finer`` gives the masks by which a dense cell is cut again."""
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= k
    heads = written(cells.groupBy("c", "v").agg(F.min(F.struct("id", "f")).alias("h"), F.count("*").alias("n")).filter("n > 1").select("c", "v", F.col("h.id").alias("head"), F.col("h.f").alias("hf")), "heads")
    met = written(cells.hint("merge").join(heads, ["c", "v"]), "met")
    star = met.filter((F.col("id") != F.col("head")) & near("f", "hf")).select(F.col("id").alias("a"), F.col("head").alias("b")).distinct()
    first = components(star)
    known = met.select("c", "v", "id", "f").hint("merge").join(first.withColumnRenamed("node", "id"), "id", "left").select("c", "v", "id", "f", F.coalesce("root", "id").alias("root"))
    stars = first.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    found = stars
    while True:
        known = written(known, "known")
        sizes = known.groupBy("c", "v", "root").agg(F.count("*").alias("n")).groupBy("c", "v")
        main = sizes.agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots"), (F.sum("n") - F.max("n")).alias("others"))
        main = written(main.filter("roots > 1").select("c", "v", "main", "others"), "main")
        dense = main.filter(F.col("others") > DENSE)
        many = [r.c for r in dense.select("c").distinct().collect()] if finer else []  # block choices, not buckets
        mixed = known.hint("merge").join(main.filter(F.col("others") <= DENSE) if many else main, ["c", "v"])
        other = mixed.filter("root != main").select("c", "v", F.col("id").alias("id2"), F.col("f").alias("f2"), F.col("root").alias("root2"))
        cross = mixed.hint("merge").join(other, ["c", "v"]).filter((F.col("root") != F.col("root2")) & near("f", "f2"))
        found = found.unionByName(cross.select(F.greatest("id", "id2").alias("a"), F.least("id", "id2").alias("b")).distinct())
        if not many:
            return components(found).withColumnRenamed("node", "id")
        table = known.sparkSession.createDataFrame([(c, finer(c)) for c in many], "c long, cs array<long>")
        again = known.hint("merge").join(dense.select("c", "v"), ["c", "v"], "left_semi").join(F.broadcast(table), "c")
        known = again.select(F.explode("cs").alias("c"), "id", "f", "root").select("c", F.col("f").bitwiseAND(F.col("c")).alias("v"), "id", "f", "root").distinct()


def _across(similarity: float) -> Callable[[pa.Table], pa.Table]:
    """Nodes (i, j, x, id, root, n, size, lacks, d) of blocks i and j of one head -> (a, b), links that join their components as
    all links between the blocks would. A set has n elements, the head size of them; lacks of the head's aren't in the set, and d
    holds these and those that the head lacks."""

    def run(t: pa.Table) -> pa.Table:
        x, ids, root, n, size, lacks = (t.column(c).to_numpy() for c in ("x", "id", "root", "n", "size", "lacks"))
        d = t.column("d").combine_chunks()
        owner = np.repeat(np.arange(len(ids)), d.value_lengths().to_numpy())
        at, seen = np.unique(d.flatten().to_numpy(), return_inverse=True, return_counts=True)[1:]
        owner, at = owner[seen[at] > 1], at[seen[at] > 1]  # what one set alone holds is in common with none
        holders, begins = owner[np.argsort(at, kind="stable")], np.append(0, np.cumsum(np.where(seen > 1, seen, 0)))
        mine = np.searchsorted(owner, np.arange(len(ids) + 1))
        names, own, often = np.unique(root, return_inverse=True, return_counts=True)
        top = np.arange(len(names))  # of each root, the one it has been joined to
        one = t.column("i")[0].as_py() == t.column("j")[0].as_py()
        left, right = [], []
        for a in np.flatnonzero(own != often.argmax()).tolist():  # of two components one isn't the main one
            open_ = top[own] != top[own[a]]
            if not one:
                open_ &= x != x[a]
            if not open_.any():
                continue
            lists = [holders[begins[e] : begins[e + 1]] for e in at[mine[a] : mine[a + 1]].tolist()]
            both = size - lacks[a] - lacks + (np.bincount(np.concatenate(lists), minlength=len(ids)) if lists else 0)
            for b in np.flatnonzero(open_ & (both / np.maximum(1, n + n[a] - both) >= similarity)).tolist():
                if top[own[a]] != top[own[b]]:
                    left, right = [*left, ids[a]], [*right, ids[b]]
                    top[top == top[own[b]]] = top[own[a]]
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return run


def first_elements(hashes: np.ndarray, similarity: float) -> tuple[np.ndarray, int]:
    """The elements of a set (in order) among which its prefix lies, and how many of them are too many.

    Two sets of the Jaccard ``similarity`` s share s * n elements at least of the n of either, so in whatever order, the same for all, their first common
    element is one of the first n - ceil(s * n) + 1 of both: the prefix. In the order used here elements below LOW come first, those that fewest sets
    hold at their head, then the others by their value; so those below LOW, or as many as the prefix has if that is more, hold the prefix."""
    n = len(hashes)
    prefix = min(n, n - ceil(similarity * n - 1e-9) + 1)
    low = hashes[: max(prefix, int(np.searchsorted(hashes, np.uint64(LOW))))]
    return low, len(low) - prefix


def prefix_cells(lows: DataFrame) -> DataFrame:
    """lows(id, low array<long>, skip) of first_elements, equal ids equal -> cells (c, v, id): a row for each element of a node's prefix that stands in another
    node's prefix too. Every two nodes at the similarity meet in one. An element that one node alone has is of no use but comes first, so
    a text of which a fifth is its own has no cell."""
    elements = lows.dropDuplicates(["id"]).select("id", "skip", F.explode("low").alias("e"))
    of = W.partitionBy("e")
    held = elements.withColumns({"n": F.count("*").over(of)}).filter("n > 1")
    mine = W.partitionBy("id")
    ranked = held.withColumns({"rank": F.row_number().over(mine.orderBy("n", "e")), "of": F.count("*").over(mine)}).filter(F.col("rank") <= F.col("of") - F.col("skip"))
    cells = written(ranked.select(F.lit(-1).cast("short").alias("c"), F.col("e").alias("v"), "id"), "prefixes")
    return cells.hint("merge").join(cells.groupBy("v").agg(F.count("*").alias("n")).filter("n > 1").select("v"), "v", "left_semi").select("c", "v", "id")


def set_links(cells: DataFrame, sets: DataFrame, similarity: float, k: int) -> DataFrame:
    """cells(c, v, id, f), sets(id, s array<long>) -> (id, root) for nodes with a link: two nodes of a
    cell whose sets have the Jaccard ``similarity`` at least. Sets whose f differ in more than ``k``
    bits are likely further apart and wait for the comparison in blocks, which leaves nothing out.

    The node of a cell that meets most others in all cells together is of a text and its many copies,
    which differ less from it than from each other, the text. It need not stand in every cell of the
    group, so each node names the best one of all its cells, and the best one named is the cell's
    head. All nodes of a cell are held against the head. What isn't of the cell's main component then is held against one more head
    of its own. What is left is compared inside tasks, block against block of one head's nodes: each as what it holds and the head
    lacks or the reverse, which tells what any two have in common. Pairs are never rows: a block gives one link for two components at most."""
    alike = F.col("inter") / (F.col("n") + F.col("m") - F.col("inter")) >= similarity
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= k
    size, main_of = F.count("*").alias("size"), F.max_by("root", F.struct("n", "root")).alias("main")

    def compared(pairs: DataFrame, *more: Column) -> DataFrame:
        """(a, b) with both sizes, how much they share, and ``more`` of the sets a_s and b_s."""
        side = lambda x: sets.select(F.col("id").alias(x), F.col("s").alias(f"{x}_s"))
        both = pairs.select("a", "b").distinct().hint("merge").join(side("a"), "a").hint("merge").join(side("b"), "b")
        return both.select("a", "b", F.size("a_s").alias("n"), F.size("b_s").alias("m"), F.size(F.array_intersect("a_s", "b_s")).alias("inter"), *more)

    def rooted(known: DataFrame, links_: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The rows with their component, and those of cells with more than one, with the main one."""
        roots = components(links_).withColumnRenamed("node", "id")
        known = written(known.drop("root").hint("merge").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "known")
        per = known.groupBy("c", "v", "root").agg(F.count("*").alias("n"), F.max(F.col("id") == F.col("head")).alias("own"))
        per = per.groupBy("c", "v").agg(main_of, F.count("*").alias("roots"), F.sum("n").alias("size"), F.max("own").alias("own"))
        # two nodes of which one is the head are done with
        mixed = known.hint("merge").join(per.filter("roots > 1 AND NOT (size = 2 AND own)").select("c", "v", "main"), ["c", "v"])
        return known, written(mixed, "mixed")

    many = cells.groupBy("c", "v").agg(size).filter("size > 1")
    met = written(cells.hint("merge").join(many, ["c", "v"]), "met")
    met = written(met.hint("merge").join(met.groupBy("id").agg(F.sum("size").alias("meets")), "id"), "met")
    best = F.max(F.struct("meets", "id")).alias("best")
    named = met.select("c", "v", "id").hint("merge").join(met.groupBy("c", "v").agg(best), ["c", "v"])
    named = named.select("c", "v", "id").hint("merge").join(named.groupBy("id").agg(F.max("best").alias("best")), "id")
    heads = named.groupBy("c", "v").agg(F.max("best").alias("best")).select("c", "v", F.col("best.id").alias("head"))
    known = written(met.select("c", "v", "id", "f", "meets").hint("merge").join(heads, ["c", "v"]), "known")
    first = written(compared(known.filter("id != head").select(F.col("id").alias("a"), F.col("head").alias("b"))), "first")
    found = first.filter(alike).select("a", "b")
    known, mixed = rooted(known, found)
    rest = mixed.filter("root != main")
    second = rest.groupBy("c", "v").agg(F.max_by(F.struct("id", "f", "root"), F.struct("meets", "id")).alias("h"))
    again = rest.hint("merge").join(second, ["c", "v"]).filter("root != h.root").filter(F.bit_count(F.col("f").bitwiseXOR(F.col("h.f"))) <= k)
    found = written(found.unionByName(compared(again.select(F.col("id").alias("a"), F.col("h.id").alias("b"))).filter(alike).select("a", "b")), "links")
    known, mixed = rooted(known, found)
    asked = written(mixed.groupBy("head", "id").agg(F.first("root").alias("root")), "asked")
    apart = F.concat(F.array_except("a_s", "b_s"), F.array_except("b_s", "a_s")).alias("d")
    apart = compared(asked.select(F.col("id").alias("a"), F.col("head").alias("b")), apart)
    apart = apart.select(F.col("a").alias("id"), F.col("b").alias("head"), "n", F.col("m").alias("size"), (F.col("m") - F.col("inter")).alias("lacks"), "d")
    nodes = written(asked.hint("merge").join(apart, ["head", "id"]), "apart")
    blocks = F.greatest(F.ceil(F.sum(F.size("d")) / ELEMENTS), F.ceil(F.count("*") / NODES))
    dealt = nodes.hint("merge").join(nodes.groupBy("head").agg(blocks.alias("blocks")), "head").withColumn("x", F.pmod(F.xxhash64("id"), F.col("blocks")))
    dealt = dealt.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = dealt.select("head", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "x", "id", "root", "n", "size", "lacks", "d")
    across = cells.repartition("head", "i", "j").groupBy("head", "i", "j").applyInArrow(_across(similarity), "a long, b long")
    return components(found.unionByName(across)).withColumnRenamed("node", "id")


def _named(prints: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """prints(doc_id, fp, ...), nodes(id, fp, low), roots(id, root) -> prints with component_id."""
    named = nodes.hint("merge").join(roots, "id", "left").select("fp", "low", F.coalesce("root", "id").alias("root"))
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = written(named.hint("merge").join(least, "root").select("fp", "root", "component_id"), "named")
    return prints.hint("merge").join(named, "fp")


def near_duplicates(docs: DataFrame, size: int = 4, k: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (the smallest
    doc_id reachable over links of at most ``k`` differing bits)."""
    prints = written(fingerprints(docs, size, id_col, text_col), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("low")).select("fp", "low", F.col("fp").alias("id")), "nodes")
    masks = block_masks(nodes.count(), k)
    cell = F.explode(F.array(*[F.struct(F.lit(x).cast("long").alias("c"), F.col("fp").bitwiseAND(F.lit(x)).alias("v")) for x in masks])).alias("cell")
    roots = links(nodes.select("id", F.col("fp").alias("f"), cell).select("cell.c", "cell.v", "id", "f"), k, finer=lambda c: finer_masks(c, k))
    out = _named(prints, nodes, written(roots, "roots"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingles(data: bytes, size: int) -> np.ndarray:
    """Hashes of the distinct shingles of ``size`` words, in order; none if there is no word."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - size + 1)
    begins, ends = np.concatenate(([0], ends[:-1] + 1))[:n].tolist(), ends[-n:].tolist()
    return np.unique(np.array([xxh64_intdigest(joined[b:e], 42) for b, e in zip(begins, ends)], np.uint64))


def votes(hashes: np.ndarray) -> int:
    """The 64 bits for which over half of the hashes vote."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _STEP):
        octets = hashes[at : at + _STEP].astype("<u8").view(np.uint8).reshape(-1, 8)
        for i in range(8):
            counts[8 * i : 8 * i + 8] += np.bincount(octets[:, i], minlength=256) @ _BITS
    return int(((counts * 2 > len(hashes)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def band_count(similarity: float, rows: int, miss: float) -> int:
    """Bands of ``rows`` minima of which a pair at ``similarity`` shares none with a chance of ``miss`` at most."""
    return max(1, ceil(log(miss) / log1p(-(similarity**rows)))) if similarity < 1 else 1


@cache
def _mixes(n: int) -> tuple[np.ndarray, np.ndarray]:
    mul, add = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 64, (2, n), np.uint64)
    return mul | np.uint64(1), add


def min_bands(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit value for each band: two sets agree on one with their Jaccard similarity to the power of ``rows``."""
    mul, add = _mixes(bands * rows)
    low = np.full(bands * rows, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(low, (hashes[at : at + 1024, None] * mul + add).min(axis=0), out=low)
    x = (low * np.roll(mul, 1)).reshape(bands, rows).sum(axis=1, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def similar_documents(docs: DataFrame, size: int = 5, similarity: float = 0.8, rows: int = 5, miss: float = 0.0005, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As near_duplicates, for links at a given Jaccard ``similarity`` of shingle sets, which is too
    wide for blocks of fingerprint bits: at 0.8 about one bit in seven differs, and the blocks needed
    grow with the number of documents. First candidates agree on a band of ``rows`` minima of the set; there
    are as many bands as keep the chance of missing a pair at the threshold under ``miss``, whatever
    the number of documents, as unrelated sets have no minima in common. The pairs that this misses by chance
    are candidates too: all pairs at the similarity share an element of their prefixes (first_elements). Of the candidates, pairs
    whose sets have the similarity exactly are kept; fingerprints of 64 bits, in which each distinct shingle votes once,
    only tell which are compared early. So the components are those of a comparison of all pairs. doc_id, text_key (xxhash64),
    root (the component's set) and component_id of each row."""
    key = lambda i, t: [F.coalesce(i, F.lit(0)).alias("k1"), i.isNull().alias("k2"), t.alias("k3")]
    text = F.col(text_col).cast("binary")
    table = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t"), F.xxhash64(text).alias("text_key"))
    bands = band_count(similarity, rows, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch, 1)):
            sets = [shingles(t or b"", size) for t in b.column(1).to_pylist()]
            fp = pa.array([xxh3_128_digest(x.astype("<u8").tobytes()) for x in sets], pa.binary())
            f = pa.array(np.array([votes(x) for x in sets], np.uint64).view(np.int64))
            minima = np.array([min_bands(x, bands, rows) for x in sets], np.uint64).reshape(-1).view(np.int64)
            minima = pa.ListArray.from_arrays(np.arange(0, len(sets) * bands + 1, bands, dtype=np.int32), pa.array(minima))
            low, skip = zip(*[first_elements(x, similarity) for x in sets]) if sets else ((), ())
            low, skip = pa.array([x.view(np.int64) for x in low], pa.list_(pa.int64())), pa.array(skip, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), fp, f, minima, low, skip], ["doc_id", "text_key", "fp", "f", "bands", "low", "skip"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 1):
                sets = [shingles(t or b"", size).view(np.int64) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "s"])

    prints = written(table.mapInArrow(run, "doc_id long, text_key long, fp binary, f long, bands array<long>, low array<long>, skip int"), "fingerprints")
    prefixes = prefix_cells(prints.select(F.xxhash64("fp").alias("id"), "low", "skip"))
    prints = prints.drop("low", "skip")
    one = F.min(F.struct("doc_id", "text_key")).alias("one")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), one, F.first("f").alias("f"), F.first("bands").alias("bands")).withColumn("id", F.xxhash64("fp")), "nodes")
    cells = nodes.select("id", "f", F.posexplode("bands").alias("c", "v")).select(F.col("c").cast("short").alias("c"), "v", "id", "f")
    many = cells.groupBy("c", "v").agg(F.count("*").alias("n")).filter("n > 1").select("c", "v")
    cells = cells.hint("merge").join(many, ["c", "v"], "left_semi").select("c", "v", "id", "f")
    cells = written(cells.unionByName(prefixes.hint("merge").join(nodes.select("id", "f"), "id").select("c", "v", "id", "f")), "cells")
    # the sets of the nodes that meet another one, made anew from one text of each
    wanted = nodes.hint("merge").join(cells.select("id").distinct(), "id", "left_semi").select("id", *key(F.col("one.doc_id"), F.col("one.text_key")))
    texts = table.select("t", *key(F.col("doc_id"), F.col("text_key"))).hint("merge").join(wanted, ["k1", "k2", "k3"])
    texts = texts.groupBy("k1", "k2", "k3").agg(F.first("id").alias("id"), F.first("t").alias("t"))
    sets = written(texts.select("id", "t").mapInArrow(hashed, "id long, s array<long>"), "sets")

    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)  # of differing bits: equal sets of this Jaccard similarity have that cosine
    roots = set_links(cells, sets, similarity, int(64 * share + 6 * (64 * share * (1 - share)) ** 0.5))
    return _named(prints.drop("f", "bands"), nodes.select("id", "fp", "low"), written(roots, "roots")).select("doc_id", "text_key", "root", "component_id")


def one_of_each(docs: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, with one row of each component of similar_documents: that of
    the smallest id (null ids last); of repeated rows one stays."""
    groups = similar_documents(docs, size, similarity, id_col=id_col, text_col=text_col)
    stays = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_key")).alias("s"))
    keys = lambda i, t: [F.coalesce(i, F.lit(0)).alias("k1"), i.isNull().alias("k2"), t.alias("k3")]
    stays = written(stays.select(*keys(F.col("s.doc_id"), F.col("s.text_key"))), "stays")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    inner = docs.select(row, *keys(F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("binary"))))
    left = inner.hint("merge").join(stays, ["k1", "k2", "k3"], "left_semi")  # repeated rows meet in the same shuffle
    return left.groupBy("k1", "k2", "k3").agg(F.first("row").alias("row")).select("row.*")
