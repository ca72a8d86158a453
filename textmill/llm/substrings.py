"""Removal of repeated word sequences by seed and extend.

Seeds: every window of ``length`` words names its anchor, the leftmost smallest hash among its
word k-grams (winnowing), so equal windows have equal anchors at equal offsets. The windows of
one anchor form a stretch of text around it: the anchor extended both ways as far as it is the
windows' anchor. Documents are joined on anchors that occur more than once. Where the whole
stretches are equal, all their windows are repeats; only where one anchor has different
stretches - the ends of repeats - single windows are compared, one copy of each stretch. Windows
that overlap then add up to the maximal repeats of ``length`` words or more.

No pairs are made: repeats are found by counts of hashes, which are partial aggregates. A stretch
is known by two 64-bit hashes (its anchor's and its own), a window by 96 bits of two.

Defined results: null and empty texts have no words; texts under ``length`` words lose none;
a null id is an id like any other; repeated rows repeat each other's windows; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ._scratch import written
from ._text import slices

_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any stretch of words from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, words: list[bytes], base: int = _BASES[0]):
        n = len(words)
        h = np.fromiter(map(xxh64_intdigest, words), np.uint64, n)
        up, down = np.full(n + 1, np.uint64(base)), np.full(n + 1, np.uint64(pow(base, -1, 1 << 64)))
        up[0] = down[0] = 1
        self.down = np.cumprod(down)
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(h * np.cumprod(up)[:n])))

    def __call__(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return _mix((self.sums[start + size] - self.sums[start]) * self.down[start] + np.asarray(size).astype(np.uint64))


def anchors(words: list[bytes], length: int, k: int) -> tuple[np.ndarray, ...]:
    """anchor hash, stretch hash, first window, number of windows of each anchor of a text."""
    n = len(words) - length + 1
    if n < 1:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    roll = Rolling(words)
    grams = roll(np.arange(len(words) - k + 1), k)
    span = length - k + 1
    at = np.empty(n, np.int64)
    for b in range(0, n, 1 << 16):  # leftmost smallest of each window
        part = np.lib.stride_tricks.sliding_window_view(grams[b : b + (1 << 16) + span - 1], span)
        at[b : b + len(part)] = np.arange(b, b + len(part)) + part.argmin(axis=1)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    count = np.diff(np.concatenate((first, [n])))
    whole = _mix(roll(first, count + length - 1) + (at[first] - first).astype(np.uint64))
    return grams[at[first]].view(np.int64), whole.view(np.int64), first, count


def _lists(columns: list[list[np.ndarray]], kinds: list[pa.DataType]) -> list[pa.Array]:
    out = []
    for c, kind in zip(columns, kinds):
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in c]))).astype(np.int32)
        flat = np.concatenate(c) if c else np.zeros(0, np.int64)
        out.append(pa.ListArray.from_arrays(offsets, pa.array(flat).cast(kind)))
    return out


def repeats(docs: DataFrame, length: int = 35, k: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_text (words joined by a space).
    Words covered by a window of ``length`` words that also starts anywhere else are removed."""
    text = F.col(text_col).cast("binary")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("r1"), F.xxhash64(text).alias("r2"), text.alias("text"))

    # a stretch's place in its text: first window and number of windows in one long
    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                found = [anchors((t or b"").split(), length, k) for t in part.column(2).to_pylist()]
                lists = _lists([[f[0] for f in found], [f[1] for f in found], [f[2] << 16 | f[3] for f in found]], [pa.int64()] * 3)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *lists], ["r1", "r2", "a", "s", "at"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                columns: list[list] = [[] for _ in range(5)]
                for rid, t, ats, ones in zip(*(c.to_pylist() for c in part.columns)):
                    words, at = (t or b"").split(), np.array(ats, np.int64)
                    lo, n = at >> 16, at & 0xFFFF
                    ends = np.cumsum(n)
                    start = np.repeat(lo - ends + n, n) + np.arange(ends[-1])
                    h1, h2 = (Rolling(words, b)(start, length) for b in _BASES)
                    for c, x in zip(columns, (np.full(len(start), rid), start, np.repeat(np.array(ones, bool), n), h1.view(np.int64), (h2 >> np.uint64(32)).astype(np.uint32).view(np.int32))):
                        c.append(x)
                kinds = [np.int64, np.int64, bool, np.int64, np.int32]
                flat = [np.concatenate(c) if c else np.zeros(0, kind) for c, kind in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in flat], ["rid", "lo", "once", "h1", "h2"])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                counts, gone, kept = [], [], []
                for t, ats in zip(*(part.column(i).to_pylist() for i in (1, 2))):
                    words = (t or b"").split()
                    counts.append(len(words))
                    if ats:
                        edge, at = np.zeros(len(words) + 1, np.int64), np.array(ats, np.int64)
                        np.add.at(edge, at >> 16, 1)
                        np.add.at(edge, (at >> 16) + (at & 0xFFFF) + length - 1, -1)
                        words = [w for w, c in zip(words, np.cumsum(edge[:-1]).tolist()) if not c]
                    gone.append(counts[-1] - len(words))
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    found = base.select("r1", "r2", "text").mapInArrow(seeds, "r1 long, r2 long, a array<long>, s array<long>, at array<long>")
    found = written(found.withColumn("rid", F.monotonically_increasing_id()), "anchors")
    keys = found.select("rid", "r1", "r2")
    rows = found.select("rid", F.explode(F.arrays_zip("a", "s", "at")).alias("x")).select("rid", "x.a", "x.s", "x.at")
    shared = written(rows.groupBy("a").agg(F.count("*").alias("c")).filter("c > 1").select("a"), "shared")
    met = written(rows.hint("merge").join(shared, "a"), "met")
    stretches = written(met.groupBy("a", "s").agg(F.count("*").alias("c"), F.min(F.struct("rid", "at")).alias("one")), "stretches")
    equal = met.hint("merge").join(stretches.filter("c > 1").select("a", "s"), ["a", "s"]).select("rid", "at")
    mixed = stretches.groupBy("a").agg(F.count("*").alias("d")).filter("d > 1").select("a")
    ends = stretches.hint("merge").join(mixed, "a").select("one.rid", "one.at", (F.col("c") == 1).alias("once"))
    ends = ends.groupBy("rid").agg(F.collect_list(F.struct("at", "once")).alias("x"))  # of one document
    ends = ends.hint("merge").join(keys, "rid").select("rid", "r1", "r2", F.col("x.at").alias("ats"), F.col("x.once").alias("ones"))
    # the joins with ``base`` below share one shuffle of the texts: they stand in one plan
    single = base.hint("merge").join(ends, ["r1", "r2"]).select("rid", "text", "ats", "ones").mapInArrow(windows, "rid long, lo long, once boolean, h1 long, h2 int")
    # a stretch that occurs once stands in a row that isn't repeated, so its windows come once each
    twice = single.groupBy("h1", "h2").agg(F.count("*").alias("c")).filter("c > 1").select("h1", "h2")
    # stretches that occur twice are repeats as they stand; only the others' windows are still asked for
    some = single.filter("once").select("rid", "lo", "h1", "h2").hint("merge").join(twice, ["h1", "h2"]).select("rid", (F.shiftleft("lo", 16) + 1).alias("at"))
    cover = equal.unionByName(some).groupBy("rid").agg(F.collect_list("at").alias("ats")).hint("merge").join(keys, "rid")
    cover = cover.groupBy("r1", "r2").agg(F.flatten(F.collect_list("ats")).alias("ats"))
    out = base.hint("merge").join(cover, ["r1", "r2"], "left").select("doc_id", "text", "ats")
    return out.mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept_text string")
