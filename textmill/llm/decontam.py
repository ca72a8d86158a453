"""Benchmark decontamination by the q-gram lemma.

Items are cut into overlapping segments. A document region within ``e`` edits of a segment of
``m`` characters shares ``m - q + 1 - q * e`` of its q-grams at least, and all of them lie in a
band of diagonals (place in the document minus place in the segment) ``e`` wide. So shared
q-grams are counted in bands of 2e diagonals that overlap by half; bands that reach the bound
are aligned (banded, free ends in the document) and kept if the edits are within the budget.

Passages that many items share cost little and lose nothing: equal segments are one; segments
that hold the same eight q-grams at the same place share one counter for them; a segment leaves
its most frequent q-grams out and lowers its bound by their number, so the lemma still holds; and
segments with a common beginning are aligned as one for as long as they agree.

Texts are compared in lower case with everything but letters and digits as single spaces. The
benchmark goes to the tasks in blocks of about ``block_chars`` characters. The driver gathers
and broadcasts one block at a time, and each block is a pass over the documents, so neither what
the driver nor what a task holds grows with the benchmark.

Defined results: null or empty texts and items hold nothing; an item of fewer than ``min_chars``
normalised characters is found where it stands whole, letter for letter and not inside a longer
word; items are the distinct rows (item_id, text) of the benchmark, so repeated rows count once
and two texts under one id are two items; a null item_id or doc_id is returned as null; repeated
documents are returned once each; empty tables give an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import kept_rows, slices

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22
_GROUP = 8  # q-grams that share a counter
_OFTEN = 64  # a q-gram in more segments than this may be left out
_LEAST = 3  # hits that a segment still asks for after that
_REACH = 1 << 15  # characters looked at together
_GAP = np.uint32(1 << 21)  # a character that no text holds
SCHEMA = "doc_id long, item_id long, start_char long, end_char long, segments long, edits long, cover double"


@lru_cache(1)
def _folding() -> np.ndarray:
    """Code point -> its lower case letter or digit, else a space; from U+30000 on as it is."""
    out = np.full(0x110000, 32, np.uint32)
    for i in range(0x30000):
        c = chr(i)
        if c.isalnum():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    out[0x30000:] = np.arange(0x30000, 0x110000)
    return out


def fold(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Normalised code points, and where each stood."""
    points = _folding()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    blank = points == 32
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    at = np.flatnonzero(keep)
    if len(at) and points[at[0]] == 32:
        at = at[1:]
    if len(at) and points[at[-1]] == 32:
        at = at[:-1]
    return points[at], at


def qgram_hashes(points: np.ndarray, q: int) -> np.ndarray:
    if len(points) < q:
        return np.zeros(0, np.uint64)
    out, width, power = points.astype(np.uint64), 1, _MULT
    done = np.zeros(len(points), np.uint64)
    used, rest = 0, q
    with np.errstate(over="ignore"):
        while rest:  # doubling: hashes of 1, 2, 4 ... characters; the binary digits of q are put together
            if rest & 1:
                n = len(points) - used - width + 1
                done = out[:n] if not used else (done[:n] * power + out[used : used + n])
                used += width
            rest >>= 1
            if rest:
                out = out[: len(out) - width] * power + out[width:]
                power, width = power * power, 2 * width
        return done * _MULT


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... n times, for each."""
    ends = np.cumsum(n)
    return np.repeat(first - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)


def _begins(sorted_: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(sorted_)), bool), sorted_[1:] != sorted_[:-1])))


class Index:
    """Segments of a block of the benchmark, in order of their characters, and the places of their q-grams."""

    def __init__(self, items: list[tuple[int | None, str]], q: int, segment: int, rate: float, min_chars: int):
        self.q, self.names = q, []
        held: dict[bytes, list[int]] = {}
        brief: dict[int, dict[bytes, list[int]]] = {}
        self.parts: list[int] = []  # segments of each item
        for name, text in items:
            p, _ = fold(text or "")
            if not len(p):
                continue
            number = len(self.names)
            self.names.append(name)
            if len(p) < max(min_chars, q):
                brief.setdefault(len(p), {}).setdefault(p.tobytes(), []).append(number)
                self.parts.append(1)
                continue
            starts = [*range(0, max(1, len(p) - segment + 1), max(1, segment // 2))]
            if starts[-1] + segment < len(p):
                starts.append(len(p) - segment)
            own = {p[s : s + segment].astype(">u4").tobytes() for s in starts}
            self.parts.append(len(own))
            for part in own:
                held.setdefault(part, []).append(number)
        # whole short items: their number follows the segments'
        order = sorted(held)
        self.owners = [held[x] for x in order]
        self.brief: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for size, group in sorted(brief.items()):
            points = np.array([np.frombuffer(x, np.uint32) for x in group])
            hashes = np.array([qgram_hashes(x, size)[0] for x in points], np.uint64)
            by = np.argsort(hashes, kind="stable")
            owners = list(group.values())
            self.brief.append((size, hashes[by], points[by], len(self.owners) + np.arange(len(by))))
            self.owners += [owners[i] for i in by]
        self.size = np.array([len(x) // 4 for x in order], np.int64)
        self.edits = np.minimum((self.size * rate).astype(np.int64), np.maximum(0, (self.size - q) // q))
        self.bound = np.maximum(1, self.size - q + 1 - q * self.edits)
        self.points = np.zeros((len(order), segment), np.uint32)
        for i, x in enumerate(order):
            self.points[i, : len(x) // 4] = np.frombuffer(x, ">u4")
        self._prefixes()
        self._postings()

    def _prefixes(self) -> None:
        """prefix[i, s]: a number that segments with the same first i + 1 characters share."""
        same = self.points[1:] == self.points[:-1]
        agree = np.where(same.all(axis=1), same.shape[1], same.argmin(axis=1)) if len(same) else np.zeros(0, np.int64)
        new = np.concatenate((np.ones((self.points.shape[1], min(1, len(self.points))), bool), agree[None, :] <= np.arange(self.points.shape[1])[:, None]), axis=1)
        self.prefix = np.cumsum(new, axis=1, dtype=np.int32)

    def _postings(self) -> None:
        n, wide = len(self.points), max(0, self.points.shape[1] - self.q + 1)
        grams = np.zeros((n, wide), np.uint64)
        for k in range(self.q):
            grams = grams * _MULT + self.points[:, k : k + wide]
        grams *= _MULT
        valid = np.arange(wide)[None, :] < (self.size - self.q + 1)[:, None]
        count = np.zeros((n, wide), np.int64)
        _, which, times = np.unique(grams[valid], return_inverse=True, return_counts=True)
        count[valid] = times[which]
        rank = np.empty_like(count)
        np.put_along_axis(rank, np.argsort(-count, axis=1, kind="stable"), np.arange(wide)[None, :], axis=1)
        out = (rank < (self.bound - _LEAST)[:, None]) & (count > _OFTEN)
        self.bound = self.bound - out.sum(axis=1)
        kept = valid & ~out
        # counters: the kept q-grams of eight places in a row, with the edits, which decide the bands' width
        blocks = -(-wide // _GROUP)
        mixed = np.where(kept, grams | np.uint64(1), 0)
        mixed = np.pad(mixed, ((0, 0), (0, blocks * _GROUP - wide))).reshape(n, blocks, _GROUP)
        label = np.repeat(np.arange(blocks, dtype=np.uint64)[None, :], n, axis=0) + self.edits.astype(np.uint64)[:, None] * np.uint64(blocks)
        for g in range(_GROUP):
            label = (label ^ (label >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + mixed[:, :, g]
        _, first, node = np.unique(label.ravel(), return_index=True, return_inverse=True)
        by = np.argsort(node, kind="stable")
        self.node_segments = by // max(1, blocks)
        self.node_first = np.searchsorted(node[by], np.arange(len(first)))
        self.node_count = np.bincount(node, minlength=len(first))
        s, b = first // max(1, blocks), first % max(1, blocks)
        place = b[:, None] * _GROUP + np.arange(_GROUP)[None, :]
        there = (place < wide) & kept[s[:, None], np.minimum(place, max(0, wide - 1))] if wide else np.zeros(place.shape, bool)
        self.node_edits = self.edits[s]
        node_of = np.repeat(np.arange(len(first)), _GROUP).reshape(-1, _GROUP)[there]
        place = place[there]
        flat = grams[s[node_of], place]
        order = np.argsort(flat, kind="stable")
        self.node, self.place = node_of[order], place[order]
        self.keys, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.slot = np.full(1 << _BITS, -1, np.int32)  # of the first key with these leading bits
        self.slot[self.keys[::-1] >> np.uint64(64 - _BITS)] = np.arange(len(self.keys))[::-1]

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the text whose q-gram is a key, and the keys' numbers."""
        slot = self.slot[hashes >> np.uint64(64 - _BITS)]
        at = np.flatnonzero(slot >= 0)
        slot, sought = slot[at].astype(np.int64), hashes[at]
        less = np.flatnonzero(self.keys[slot] < sought)
        while len(less):  # keys with the same leading bits stand side by side
            slot[less] += 1
            less = less[slot[less] < len(self.keys)]
            less = less[self.keys[slot[less]] < sought[less]]
        same = (slot < len(self.keys)) & (self.keys[np.minimum(slot, len(self.keys) - 1)] == sought)
        return at[same], slot[same]

    def regions(self, points: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(segment, edits, first, last place) of every region of the text within the budget."""
        out = self._whole(points)
        if not len(self.keys):
            return out
        at, slot = self.lookup(qgram_hashes(points, self.q))
        if not len(at):
            return out
        # a band's hits lie within two segments' length, so stretches that overlap by as much hold each band whole
        length = self.points.shape[1]
        begin = 0
        while begin < len(at):
            end = int(np.searchsorted(at, at[begin] + _REACH))
            out += self._stretch(points, at[begin:end], slot[begin:end])
            if end >= len(at):
                break
            begin = max(begin + 1, int(np.searchsorted(at, at[end - 1] + 1 - 2 * length)))
        return out

    def regions_of(self, texts: list[np.ndarray]) -> list[list[tuple[int, int, int, int]]]:
        """regions() of each text. Short texts are looked at together, with a gap between that no
        alignment can cross."""
        gap = np.full(self.points.shape[1], _GAP)
        out: list[list[tuple[int, int, int, int]]] = []
        a = 0
        while a < len(texts):
            b, held = a, 0
            while b < len(texts) and (b == a or held + len(texts[b]) <= _REACH):
                held += len(texts[b]) + len(gap)
                b += 1
            size = np.array([len(t) for t in texts[a:b]])
            start = np.cumsum(size + len(gap)) - size - len(gap)
            part: list[list[tuple[int, int, int, int]]] = [[] for _ in range(a, b)]
            for seg, edits, first, last in self.regions(np.concatenate([x for t in texts[a:b] for x in (t, gap)])):
                i = int(np.searchsorted(start, last - 1, "right")) - 1
                part[i].append((seg, edits, max(0, first - int(start[i])), min(int(size[i]), last - int(start[i]))))
            out += part
            a = b
        return out

    def _stretch(self, points: np.ndarray, at: np.ndarray, slot: np.ndarray) -> list[tuple[int, int, int, int]]:
        length, n = self.points.shape[1], self.count[slot]
        pick = _spread(self.first[slot], n)
        at, node, place = np.repeat(at, n), self.node[pick], self.place[pick]
        enough = self._enough(node)  # a segment with fewer hits than its bound has no band that reaches it
        at, node, place = at[enough], node[enough], place[enough]
        if not len(at):
            return []
        from_ = int(at[0])
        band = (at - from_ - place + length) // np.maximum(1, self.node_edits[node]) + 1  # never under 1
        bands = int(band.max()) + 1
        key = np.concatenate((node * bands + band, node * bands + band - 1)) * length + np.concatenate((place, place))
        key.sort()
        key = key[_begins(key)] // length  # a q-gram counts once in a band
        first = _begins(key)
        hits = np.diff(np.concatenate((first, [len(key)])))
        node, band = key[first] // bands, key[first] % bands
        order = np.argsort(band)
        node, band, hits = node[order], band[order], hits[order]
        size, out, a = np.cumsum(self.node_count[node]), [], 0
        while a < len(node):  # whole bands, about two million segments at a time
            b = int(np.searchsorted(size, (size[a - 1] if a else 0) + (1 << 21)))
            b = max(a + 1, int(np.searchsorted(band, band[min(b, len(band) - 1)], "left")) if b < len(band) else len(band))
            b = max(b, int(np.searchsorted(band, band[b - 1], "right")))
            times = self.node_count[node[a:b]]
            seg = self.node_segments[_spread(self.node_first[node[a:b]], times)]
            key, weight = np.repeat(band[a:b], times) * len(self.size) + seg, np.repeat(hits[a:b], times)
            order = np.argsort(key)
            key, weight = key[order], weight[order]
            first = _begins(key)
            total, key = np.add.reduceat(weight, first), key[first]
            good = total >= self.bound[key % len(self.size)]
            seg, found = key[good] % len(self.size), key[good] // len(self.size)
            low = from_ + (found - 1) * np.maximum(1, self.edits[seg]) - length
            for i in range(0, len(seg), 1 << 16):
                out += self.align(points, seg[i : i + (1 << 16)], low[i : i + (1 << 16)])
            a = b
        return out

    def _enough(self, node: np.ndarray) -> np.ndarray:
        """Whether each hit's counter belongs to a segment with as many hits as its bound."""
        order = np.argsort(node)
        ordered = node[order]
        first = _begins(ordered)
        own, hits = ordered[first], np.diff(np.concatenate((first, [len(node)])))
        times = self.node_count[own]
        seg = self.node_segments[_spread(self.node_first[own], times)]
        by = np.argsort(seg)
        begin = _begins(seg[by])
        good = np.add.reduceat(np.repeat(hits, times)[by], begin) >= self.bound[seg[by][begin]]
        if not good.any():
            return np.zeros(len(node), bool)
        of = np.empty(len(seg), bool)
        of[by] = np.repeat(good, np.diff(np.concatenate((begin, [len(seg)]))))
        out = np.empty(len(node), bool)
        out[order] = np.repeat(np.logical_or.reduceat(of, np.cumsum(times) - times), hits)
        return out

    def align(self, points: np.ndarray, seg: np.ndarray, low: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Edits of segments against the text on the diagonals from ``low`` on, two widths and the budget
        on either side. Cell k of a row stands for i characters of the segment and place low - e + k + i.
        Segments with one ``low`` share a row as long as their characters agree; rows over the budget end."""
        order = np.lexsort((seg, low))
        seg, low = seg[order], low[order]
        budget, sizes = self.edits[seg], self.size[seg]
        e = int(budget.max(initial=0))
        k = np.arange(2 * max(1, e) + 2 * e + 1)
        rim = len(k) + 2 * self.points.shape[1]  # outside the text stand characters that equal none
        text = np.full(len(points) + 2 * rim, 1 << 22, np.uint32)
        text[rim : rim + len(points)] = points
        slope = k[None, :].astype(np.int32)
        row = np.cumsum(np.concatenate((np.zeros(min(1, len(low)), np.int64), low[1:] != low[:-1])))
        cost = np.zeros((int(row[-1]) + 1 if len(row) else 0, len(k)), np.int32)
        out = []
        for i in range(self.points.shape[1] + 1):
            last = sizes == i
            if last.any():
                c = cost[row[last]]
                best, end = c.min(axis=1), low[last] - e + c.argmin(axis=1) + i
                good = np.flatnonzero(best <= budget[last])
                s = seg[last][good]
                out += zip(s.tolist(), best[good].tolist(), np.maximum(0, end[good] - i - best[good]).tolist(), np.minimum(len(points), end[good]).tolist())
                seg, low, row, budget, sizes = (x[~last] for x in (seg, low, row, budget, sizes))
            if not len(seg):
                break
            number = self.prefix[i, seg]
            first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (number[1:] != number[:-1]))))
            old = cost[row[first]]
            place = (low[first] - e + rim + i)[:, None] + k[None, :]
            step = old + (text[place] != self.points[seg[first], i][:, None])
            np.minimum(step[:, :-1], old[:, 1:] + 1, out=step[:, :-1])
            cost = np.minimum.accumulate(step - slope, axis=1) + slope
            row = np.repeat(np.arange(len(first)), np.diff(np.concatenate((first, [len(seg)]))))
            alive = cost.min(axis=1)[row] <= budget
            if not alive.all():
                seg, low, row, budget, sizes = (x[alive] for x in (seg, low, row, budget, sizes))
        return out

    def _whole(self, points: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Short items where they stand letter for letter and not inside a longer word. Scripts from
        U+2E80 on, which don't set words apart, need no space around them."""
        out, n = [], len(points)
        edge = np.concatenate(([np.uint32(32)], points, [np.uint32(32)]))
        for size, hashes, held, numbers in self.brief:
            got = qgram_hashes(points, size)
            which = np.searchsorted(hashes, got)
            at = np.flatnonzero((which < len(hashes)) & (hashes[np.minimum(which, len(hashes) - 1)] == got))
            before, a, b, after = edge[at], points[at], points[at + size - 1] if len(at) else points[at], edge[at + size + 1]
            free = ((before == 32) | (a >= 0x2E80) | (before >= 0x2E80)) & ((after == 32) | (b >= 0x2E80) | (after >= 0x2E80))
            for p in at[free].tolist():
                w = int(which[p])
                while w < len(hashes) and hashes[w] == got[p]:
                    if (held[w] == points[p : p + size]).all():
                        out.append((int(numbers[w]), 0, p, min(n, p + size)))
                    w += 1
        return out


def _search(held, q: int, segment: int, rate: float, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(held.value, q, segment, rate, min_chars)
        for batch in batches:
            for part in slices(batch, 1):
                rows = []
                folded = [fold(t or "") for t in part.column(1).to_pylist()]
                for doc, (_, at), regions in zip(part.column(0).to_pylist(), folded, index.regions_of([f[0] for f in folded])):
                    found: dict[int, dict[int, tuple[int, int, int]]] = {}
                    for seg, edits, a, b in regions:
                        for item in index.owners[seg]:
                            was = found.setdefault(item, {}).get(seg, (edits, a, b))
                            found[item][seg] = (min(edits, was[0]), min(a, was[1]), max(b, was[2]))
                    for item, segs in sorted(found.items()):
                        f = segs.values()
                        rows.append((doc, index.names[item], int(at[min(x[1] for x in f)]), int(at[max(x[2] for x in f) - 1]) + 1, len(segs), sum(x[0] for x in f), len(segs) / index.parts[item]))
                names = [x.split()[0] for x in SCHEMA.split(", ")]
                kinds = [pa.int64()] * 6 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, q: int = 8, segment: int = 64, rate: float = 0.1, min_chars: int = 24, block_chars: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and item that share a passage: its extent in the document, the
    item's segments found, their edits, and the share of the item's segments. An item's segment
    has a budget of ``rate`` edits a character."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = _blocks(benchmark, block_chars, item_col, item_text)
    return reduce(DataFrame.unionByName, [rows.mapInArrow(_search(held, q, segment, rate, min_chars), SCHEMA) for held in blocks])


def clean(docs: DataFrame, benchmark: DataFrame, q: int = 8, segment: int = 64, rate: float = 0.1, min_chars: int = 24, block_chars: int = 4_000_000, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, that share no passage with the benchmark."""

    def test(held):
        def make():
            index = Index(held.value, q, segment, rate, min_chars)
            return lambda texts: [not found for found in index.regions_of([fold(t)[0] for t in texts])]

        return make

    return reduce(lambda rows, held: kept_rows(rows, text_col, test(held)), _blocks(benchmark, block_chars, item_col, item_text), docs)


def _blocks(benchmark: DataFrame, block_chars: int, item_col: str, item_text: str) -> Iterator:
    """Broadcasts of the benchmark's distinct rows in blocks of about ``block_chars`` characters, one
    block at least. A block is gathered when it is asked for and given up once it is broadcast."""
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t")).filter("t is not null").distinct()
    total = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    n = max(1, -(-total // block_chars))
    for b in range(n):
        yield benchmark.sparkSession.sparkContext.broadcast([tuple(r) for r in items.filter(F.pmod(F.xxhash64("t", "i"), F.lit(n)) == b).collect()])
