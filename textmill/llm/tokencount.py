"""Token counts by finite-state transducers.

The splitter of the vocabulary (contractions, runs of letters, single numbers, runs of other
characters) is compiled to a deterministic transducer over character classes. Text is cut into
chunks of equal length; each chunk's state map (for every entry state, the exit state) is made
for all chunks at once, the maps are composed by a parallel prefix scan, and with the entry
states known the transitions are run once more for what they emit: where a word begins.

Inside words the merges are a transducer as well. Byte-pair encoding is closed under prefixes: what
encodes a word's prefix is the encoding of a shorter prefix and one last token. That token is the
one vocabulary suffix of the prefix whose pair with the shorter prefix's last token outlives its own
merges, and the prefix has one token more than the shorter one. Suffixes come from a deterministic
automaton over bytes (a dense table: state, byte -> state) with each state's longest token, and from
a trie of the tokens that end words, read backwards from a word's last byte. Whether a pair of tokens
lives is told by undoing merges at their border, the later one first, and asking each time whether
the two that touched would have merged before. All words run side by side, each from the root, as the
splitter ends every word's run in a known state; nothing is remembered of words.

Defined results: a null text is an empty one (0 bytes, 0 tokens); special tokens' strings count
as one token, as the library's default has it; repeated rows get equal results; a null id stays
null; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import slices
from .merges import NONE, Merger

CHUNK = 256
FEW = 24  # words that numpy no longer pays for are stepped one by one

# classes of characters
OTHER, SPACE, LETTER, NUMBER, QUOTE, ONE, R, V, L, E = range(10)
# states: after white space; in letters; after a number; in other characters; after a quote that
# begins a word; after that quote and r, v or l; after a contraction
GAP, WORD, DIGIT, SIGNS, TICK, TICK_R, TICK_V, TICK_L, SHORT = range(9)


def transitions() -> np.ndarray:
    """[class, state] -> state."""
    t = np.empty((10, 9), np.uint8)
    t[SPACE], t[NUMBER] = GAP, DIGIT
    for c in (LETTER, ONE, R, V, L, E):
        t[c] = WORD
    t[OTHER], t[QUOTE] = SIGNS, TICK
    t[QUOTE, [SIGNS, TICK]] = SIGNS
    t[ONE, TICK], t[R, TICK], t[V, TICK], t[L, TICK] = SHORT, TICK_R, TICK_V, TICK_L
    t[E, [TICK_R, TICK_V]] = SHORT
    t[L, TICK_L] = SHORT
    return t


_STEP = transitions()


@lru_cache(1)
def classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        kind = unicodedata.category(c)[0]
        if kind == "L":
            out[i] = LETTER
        elif kind == "N":
            out[i] = NUMBER
        elif c.isspace() and not 0x1C <= i <= 0x1F:
            out[i] = SPACE
    for chars, k in (("'", QUOTE), ("stmd", ONE), ("r", R), ("v", V), ("l", L), ("e", E)):
        for c in chars:
            out[ord(c)] = k
    return out


def states(kinds: np.ndarray) -> np.ndarray:
    """The transducer's state after every character, from GAP on."""
    rows = max(1, -(-len(kinds) // CHUNK))
    grid = np.full((rows, CHUNK), SPACE, np.uint8)
    grid.ravel()[: len(kinds)] = kinds
    step, grid = _STEP.ravel(), np.ascontiguousarray(grid.T)
    maps = np.tile(np.arange(9, dtype=np.uint8), (rows, 1))
    for j in range(CHUNK):  # entry states fall together soon; rows with one exit state left need no more than that one
        if j == 32:
            same = (maps == maps[:, :1]).all(axis=1)
            one, many = maps[same, :1], maps[~same]
        if j < 32:
            maps = step[grid[j][:, None] * np.uint8(9) + maps]
        else:
            one = step[grid[j][same][:, None] * np.uint8(9) + one]
            many = step[grid[j][~same][:, None] * np.uint8(9) + many]
    maps = np.empty((rows, 9), np.uint8)
    maps[same], maps[~same] = one, many
    width = 1
    while width < rows:  # composition: the map of all chunks up to each one
        maps[width:] = np.take_along_axis(maps[width:], maps[:-width].copy(), axis=1)
        width *= 2
    now = np.concatenate((np.zeros(1, np.uint8), maps[:-1, GAP]))
    out = np.empty((CHUNK, rows), np.uint8)
    for j in range(CHUNK):
        now = step[grid[j] * np.uint8(9) + now]
        out[j] = now
    return out.T.ravel()[: len(kinds)]


def starts(kinds: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Whether each character begins a word: what the transitions emit."""
    before = np.concatenate((np.zeros(1, np.uint8), after[:-1]))
    following = np.concatenate((after[1:], np.zeros(1, np.uint8)))
    letters = (kinds == LETTER) | (kinds >= ONE)
    goes_on = (letters & ((before == WORD) | ((before >= TICK_R) & (before <= TICK_L)))) | (after == SHORT)
    goes_on |= ((kinds == OTHER) | (kinds == QUOTE)) & ((before == SIGNS) | (before == TICK))
    goes_on |= (after >= TICK_R) & (after <= TICK_L) & (following == SHORT)
    return (kinds != SPACE) & ~goes_on


class Counter:
    """Counts of a vocabulary file of the word-end kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        vocab, end = whole["model"]["vocab"], whole["model"]["end_of_word_suffix"]
        self.pairs = pairs = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(whole["model"]["merges"])}
        self.merge = Merger(pairs)
        # how each token was merged: rank (-1: a single byte), left part, right part
        self.rank, self.left, self.right = np.full((3, max(vocab.values()) + 1), -1, np.int64)
        for (a, b), (rank, token) in pairs.items():
            self.rank[token], self.left[token], self.right[token] = rank, a, b
        special = [t["content"] for t in whole["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special)))
        # bytes as printable characters, the usual byte-level alphabet: those that print stand for
        # themselves, the others for the code points from 256 on, in order
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        named = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in own)}
        self.inner = np.array([vocab[named[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[named[b] + end] for b in range(256)], np.int64)
        byte = {c: b for b, c in named.items()}
        inside = {bytes(map(byte.get, x)): i for x, i in vocab.items() if not x.endswith(end)}
        ending = {bytes(map(byte.get, x.removesuffix(end))): i for x, i in vocab.items() if x.endswith(end)}
        self._automaton(self._whole(inside, self.inner))
        self._endings(self._whole(ending, self.final))

    def _whole(self, tokens: dict[bytes, int], last: np.ndarray) -> dict[bytes, int]:
        """The tokens that are their own encoding."""
        data = np.frombuffer(b"".join(tokens), np.uint8)
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        ends = np.cumsum(sizes) - 1
        flat = self.inner[data]
        flat[ends] = last[data[ends]]
        counts = self.merge(flat, sizes)[1]
        return {t: i for (t, i), n in zip(tokens.items(), counts.tolist()) if n == 1}

    def _automaton(self, tokens: dict[bytes, int]) -> None:
        """goto[state, byte]; longest[state]: the longest token the bytes read end with;
        shorter[token]: the next one that this token ends with; size[token]."""
        children: list[dict[int, int]] = [{}]
        holds = {}
        for t, token in tokens.items():
            state = 0
            for b in t:
                if b not in children[state]:
                    children[state][b] = len(children)
                    children.append({})
                state = children[state][b]
            holds[state] = token
        self.goto = np.zeros((len(children), 256), np.int32)
        self.longest = np.full(len(children), -1, np.int64)
        self.shorter, self.size = np.full((2, len(self.rank)), -1, np.int64)
        for t, token in tokens.items():
            self.size[token] = len(t)
        level = [(0, b, child, 0) for b, child in children[0].items()]
        for b, child in children[0].items():
            self.goto[0, b] = child
        while level:
            below = []
            for _, _, state, fail in level:  # fail: the state of the longest proper suffix
                self.longest[state] = self.longest[fail]
                if state in holds:
                    self.shorter[holds[state]], self.longest[state] = self.longest[fail], holds[state]
                self.goto[state] = self.goto[fail]
                for b, child in children[state].items():
                    below.append((state, b, child, int(self.goto[fail, b])))
                    self.goto[state, b] = child
            level = below

    def _endings(self, tokens: dict[bytes, int]) -> None:
        """The trie of the tokens that end words, last byte first: (state << 8 | byte) -> state, and the token a state holds."""
        step: dict[int, int] = {}
        holds = {}
        for t, token in tokens.items():
            state = 0
            for b in reversed(t):
                state = step.setdefault(state << 8 | b, len(step) + 1)
            holds[state] = token
        self.arcs = np.fromiter(step, np.int64, len(step))
        order = np.argsort(self.arcs)
        self.to = np.fromiter(step.values(), np.int64, len(step))[order]
        self.arcs = self.arcs[order]
        self.ends = np.full(len(step) + 1, -1, np.int64)
        self.ends[list(holds)] = list(holds.values())

    def lives(self, s: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Whether the encoding of both tokens' bytes is these two tokens."""
        out, at = np.zeros(len(s), bool), np.arange(len(s))
        until = np.full(len(s), NONE, np.int64)  # the rank at which the two that touch now ceased to
        while len(at):
            on = self.merge.table.find(s, t)[0] >= until
            at, s, t, until = at[on], s[on], t[on], until[on]
            first, second = self.rank[s], self.rank[t]
            whole = (first < 0) & (second < 0)
            out[at[whole]] = True
            later = first > second  # of equal merges the left one comes first, so the right one is undone
            until = np.where(later, first, second + 1)  # and meets its own rank, the left one does not
            s, t = np.where(later, self.right[s], s), np.where(later, t, self.left[t])
            at, s, t, until = at[~whole], s[~whole], t[~whole], until[~whole]
        return out

    def counted(self, data: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Token counts of the words data[first : first + sizes], by the automaton."""
        last, count = np.full(len(data), -1, np.int64), np.zeros(len(data), np.int64)
        state, at, j = np.zeros(len(first), np.int64), np.flatnonzero(sizes > 1), 0
        while len(at) > FEW:
            place = first[at] + j
            state[at] = self.goto[state[at], data[place]]
            token = self.longest[state[at]]
            root = first[at]
            while len(place):
                before = place - self.size[token]
                ok = before < root
                inner = np.flatnonzero(~ok)
                ok[inner] = self.lives(last[before[inner]], token[inner])
                here = place[ok]
                last[here] = token[ok]
                count[here] = np.where(before[ok] < root[ok], 0, count[np.maximum(before[ok], 0)]) + 1
                place, root, token = place[~ok], root[~ok], self.shorter[token[~ok]]
            j += 1
            at = at[sizes[at] > j + 1]
        for i in at.tolist():
            self._walk(data, int(first[i]) + j, int(first[i] + sizes[i]) - 1, int(first[i]), int(state[i]), last, count)
        return self._finish(data, first, sizes, last, count)

    def _walk(self, data: np.ndarray, place: int, end: int, root: int, state: int, last: np.ndarray, count: np.ndarray) -> None:
        for p in range(place, end):
            state = self.goto.item(state, data.item(p))
            token = self.longest.item(state)
            while (before := p - self.size.item(token)) >= root and not self._pair(last.item(before), token):
                token = self.shorter.item(token)
            last[p], count[p] = token, (count[before] if before >= root else 0) + 1

    @lru_cache(100_000)
    def _pair(self, s: int, t: int) -> bool:
        """``lives`` of one pair."""
        until = int(NONE)
        while self.pairs.get((s, t), (until,))[0] >= until:
            first, second = self.rank.item(s), self.rank.item(t)
            if first < 0 and second < 0:
                return True
            if first > second:
                until, s = first, self.right.item(s)
            else:
                until, t = second + 1, self.left.item(t)
        return False

    def _finish(self, data: np.ndarray, first: np.ndarray, sizes: np.ndarray, last: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Each word's last token, one that ends words, on top of the prefix before it."""
        out, at = np.zeros(len(first), np.int64), np.flatnonzero(sizes > 0)
        state, before = np.zeros(len(at), np.int64), first[at] + sizes[at] - 1
        while len(at):
            arc = state << 8 | data[before]
            slot = np.minimum(np.searchsorted(self.arcs, arc), len(self.arcs) - 1)
            state, before, token = self.to[slot], before - 1, self.ends[self.to[slot]]
            root = before < first[at]
            ok = root & (token >= 0)
            asked = np.flatnonzero(~root & (token >= 0))
            ok[asked] = self.lives(last[before[asked]], token[asked])
            out[at[ok]] = np.where(root[ok], 0, count[np.maximum(before[ok], 0)]) + 1
            at, state, before = at[~ok], state[~ok], before[~ok]
        return out

    def __call__(self, texts: list[str]) -> np.ndarray:
        extra = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if "<|" in t:
                texts[i], extra[i] = self.special.subn(" ", t)
        joined = unicodedata.normalize("NFC", "\n".join(x.replace("\n", " ") for x in texts)).replace("Σ", "σ").lower()
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kinds = classes()[points]
        begin = starts(kinds, states(kinds))
        solid = kinds != SPACE
        kept = points[solid]
        first = np.flatnonzero(begin[solid])
        if not len(first):
            return extra
        size = 1 + (kept >= 0x80).astype(np.int64) + (kept >= 0x800) + (kept >= 0x10000)
        offsets = np.concatenate((np.concatenate(([0], np.cumsum(size)))[first], [size.sum()])).astype(np.int32)
        data = kept.tobytes().decode("utf-32-le").encode()
        coded = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        words = coded.dictionary
        bounds = np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1].astype(np.int64)
        counts = self.counted(np.frombuffer(words.buffers()[2], np.uint8), bounds[:-1], np.diff(bounds))
        count = counts[coded.indices.to_numpy()]
        doc = np.cumsum(points == 10)[solid][first]  # texts stand in lines of their own
        return extra + np.bincount(doc, count, len(texts)).astype(np.int64)


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every row's whole text, by the vocabulary file at ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                texts = [t or "" for t in part.column(1).to_pylist()]
                size = [len(t.encode()) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(count(texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
