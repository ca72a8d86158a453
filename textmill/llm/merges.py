"""Byte-pair merges of many words at once on padded numpy matrices.

Words of similar length stand in one matrix, a row each. Every round merges, in every row, the
leftmost pair of the smallest rank; pairs are looked up in an open-addressing hash table held
in numpy arrays; rows that have nothing to merge leave, and the merged row moves up by one.
Words over ``LONG`` symbols go through a linked list with a heap, as a round for each merge
over a whole row would cost the square of the length there."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np

NONE = np.int32((1 << 31) - 1)
LONG = 256
_MIX = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """(left id, right id) -> (rank, merged id)."""

    def __init__(self, left: Sequence[int], right: Sequence[int], rank: Sequence[int], merged: Sequence[int]):
        keys = (np.asarray(left, np.uint64) << np.uint64(32)) | np.asarray(right, np.uint64)
        bits = max(4, int(len(keys) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.rank, self.merged = np.full(1 << bits, NONE, np.int32), np.full(1 << bits, -1, np.int32)
        rank, merged = np.asarray(rank, np.int32), np.asarray(merged, np.int32)
        slot, todo = self._home(keys), np.arange(len(keys))
        while len(todo):
            at = slot[todo]
            free = self.keys[at] == np.uint64(0xFFFFFFFFFFFFFFFF)
            _, one = np.unique(at, return_index=True)  # one key for each slot and round
            take = np.zeros(len(todo), bool)
            take[one] = True
            take &= free
            won = todo[take]
            self.keys[slot[won]], self.rank[slot[won]], self.merged[slot[won]] = keys[won], rank[won], merged[won]
            lost = todo[~take]
            seen = self.keys[slot[lost]] != np.uint64(0xFFFFFFFFFFFFFFFF)
            slot[lost[seen]] = (slot[lost[seen]] + 1) & self.mask
            todo = lost

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (NONE where there is no such pair) and merged ids."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = self._home(keys)
        found = self.keys[slot]
        miss = np.flatnonzero((found != keys) & (found != np.uint64(0xFFFFFFFFFFFFFFFF)))
        while len(miss):
            slot[miss] = (slot[miss] + 1) & self.mask
            found = self.keys[slot[miss]]
            miss = miss[(found != keys[miss]) & (found != np.uint64(0xFFFFFFFFFFFFFFFF))]
        hit = self.keys[slot] == keys
        return np.where(hit, self.rank[slot], NONE), self.merged[slot]


    def get(self, left: int, right: int) -> tuple[int, int] | None:
        """Rank and merged id of one pair."""
        rank, merged = self.find(np.array([left]), np.array([right]))
        return None if rank[0] == NONE else (int(rank[0]), int(merged[0]))


def _matrix(m: np.ndarray, sizes: np.ndarray, pairs: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """m: symbols, padded at the right; sizes: of each row. The rows after all merges, and their sizes."""
    out, left = np.zeros_like(m), np.zeros_like(sizes)
    rows, cols = np.arange(len(m)), np.arange(m.shape[1])
    inside = cols[None, :-1] + 1 < sizes[:, None]
    ranks, new = np.full(m.shape, NONE, np.int32), np.full(m.shape, -1, np.int32)
    ranks[:, :-1][inside], new[:, :-1][inside] = pairs.find(m[:, :-1][inside], m[:, 1:][inside])
    while len(rows):
        at = ranks.argmin(axis=1)
        here = np.arange(len(rows))
        over = ranks[here, at] == NONE
        if over.any():
            out[rows[over]], left[rows[over]] = m[over], sizes[over]
            go = ~over
            rows, m, ranks, new, sizes, at = rows[go], m[go], ranks[go], new[go], sizes[go], at[go]
            here = np.arange(len(rows))
        if not len(rows):
            break
        m[here, at] = new[here, at]
        moved = np.minimum(cols[None, :] + (cols[None, :] > at[:, None]), m.shape[1] - 1) + here[:, None] * m.shape[1]
        m, ranks, new = m.ravel()[moved], ranks.ravel()[moved], new.ravel()[moved]  # compaction: what stands after the pair moves up
        sizes = sizes - 1
        ranks[:, -1] = NONE
        for shift in (-1, 0):  # the pairs that the merged symbol now ends and begins
            p = at + shift
            ok = (p >= 0) & (p + 1 < sizes)
            end = ~ok & (p >= 0)
            ranks[here[end], p[end]] = NONE
            ranks[here[ok], p[ok]], new[here[ok], p[ok]] = pairs.find(m[here[ok], p[ok]], m[here[ok], p[ok] + 1])
    return out, left


def _list(ids: list[int], pairs: PairTable) -> np.ndarray:
    """One long word: the same merges in the same order, by a heap of (rank, place)."""
    n = len(ids)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    ranks, merges = pairs.find(np.array(ids[:-1]), np.array(ids[1:]))
    heap = [(r, i, ids[i], ids[i + 1], m) for i, (r, m) in enumerate(zip(ranks.tolist(), merges.tolist())) if r != NONE]
    heapq.heapify(heap)
    while heap:
        _, i, a, b, merged = heapq.heappop(heap)
        j = after[i] if ids[i] == a else -1
        if j < 0 or ids[j] != b:
            continue
        ids[i], ids[j], after[i] = merged, -1, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y >= 0 and (got := pairs.get(ids[x], ids[y])):
                heapq.heappush(heap, (got[0], x, ids[x], ids[y], got[1]))
    return np.array([x for x in ids if x >= 0], np.int32)


class Merger:
    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        left, right = zip(*pairs) if pairs else ((), ())
        rank, merged = zip(*pairs.values()) if pairs else ((), ())
        self.table = PairTable(left, right, rank, merged)

    def __call__(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """flat: the symbol ids of all words, one after the other; sizes: of each word, none 0.
        The same of the ids after all merges."""
        starts = np.cumsum(sizes) - sizes
        out, count = np.zeros(len(flat), np.int32), np.zeros(len(sizes), np.int64)  # a word never grows
        order = np.argsort(sizes, kind="stable")
        ordered, width, at = sizes[order], 2, 0
        while at < len(order):
            if width > LONG:
                for i in order[at:]:
                    ids = _list(flat[starts[i] : starts[i] + sizes[i]].tolist(), self.table)
                    out[starts[i] : starts[i] + len(ids)], count[i] = ids, len(ids)
                break
            end = int(np.searchsorted(ordered, width, side="right"))
            for part in np.array_split(order[at:end], max(1, (end - at) * width >> 18)) if end > at else ():
                cols = np.arange(width)[None, :]
                m = flat[np.minimum(starts[part][:, None] + cols, len(flat) - 1)].astype(np.int32)
                ids, count[part] = _matrix(m, sizes[part], self.table)
                put = cols < count[part][:, None]
                out[(starts[part][:, None] + cols)[put]] = ids[put]
            at, width = end, width + 2 if width < 16 else width * 3 // 2
        return gather(out, starts, count), count


def gather(pool: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """pool[first[i] : first[i] + count[i]] of all i, one after the other."""
    if not len(first):
        return pool[:0]
    ends = np.cumsum(count)
    return pool[np.repeat(first - ends + count, count) + np.arange(ends[-1])]
