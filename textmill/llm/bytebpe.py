"""Byte-level BPE encoding and decoding in Arrow batches.

A text is cut by the pattern; the distinct pieces of a slice of rows are merged together on
length-bucketed padded matrices (merges.py); documents are then put together from the pieces'
ids. What was merged is remembered up to ``REMEMBER`` spans and until the task ends, as workers
live on and other stages need the memory. The ranks file
must be readable on every executor, as the library itself is; its path is a parameter.

Defined results: a null text is an empty one: no ids; special tokens aren't known, their
strings are ordinary text; repeated rows get equal results; a null id stays null; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import slices
from .merges import Merger, gather

REMEMBER = 300_000
_RUN = re.compile(r"\A |\s ")


class ByteBPE:
    """The vocabulary of a ranks file. Two adjacent parts merge if their bytes together are a
    token; its rank orders the merges."""

    def __init__(self, path: str, pattern: str):
        self.pattern = regex.compile(pattern)
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = (rank, rank)
        self.merge = Merger(pairs)
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.size = max(self.ranks.values()) + 1
        self.lengths = np.zeros(self.size, np.int64)
        for token, rank in self.ranks.items():
            self.lengths[rank] = len(token)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        named = {rank: token for token, rank in self.ranks.items()}
        self.bytes = np.frombuffer(b"".join(named.get(i, b"") for i in range(self.size)), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.known: tuple[dict[str, int], dict[str, int]] = {}, {}
        self.pool, self.first, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, flat, and how many each has."""
        data = [p.encode() for p in pieces]
        whole = np.fromiter((self.ranks.get(d, -1) for d in data), np.int64, len(data))
        sizes, flat = np.fromiter(map(len, data), np.int64, len(data)), self.byte[np.frombuffer(b"".join(data), np.uint8)]
        rest = np.flatnonzero(whole < 0)  # a piece that is a token needs no merges
        ids, some = self.merge(gather(flat, np.cumsum(sizes)[rest] - sizes[rest], sizes[rest]), sizes[rest])
        count = np.ones(len(data), np.int64)
        count[rest] = some
        out = np.repeat(whole, count).astype(np.int32)
        out[np.repeat(whole < 0, count)] = ids
        return out, count

    def learn(self, spans: list[str], known: dict[str, int], lead: str) -> None:
        """Ids of new spans, cut into pieces by the pattern."""
        cut = [self.pattern.findall(lead + s) for s in spans]
        number: dict[str, int] = {}
        of = np.fromiter((number.setdefault(p, len(number)) for c in cut for p in c), np.int64)
        ids, count = self._pieces([*number])
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        ends = np.concatenate(([0], np.cumsum(count[of])))
        last = np.cumsum(sizes)
        first = ends[last - sizes]
        known.update(zip(spans, range(len(self.first), len(self.first) + len(spans))))
        self.first = np.concatenate((self.first, len(self.pool) + first))
        self.count = np.concatenate((self.count, ends[last] - first))
        self.pool = np.concatenate((self.pool, gather(ids, (np.cumsum(count) - count)[of], count[of])))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """A space after a character that is no white space always begins a piece, so what stands
        between such spaces is cut and merged once, however often it occurs."""
        if len(self.first) > REMEMBER:
            self.forget()
        spans = []
        for t in texts:
            parts = t.split(" ")
            if _RUN.search(t):  # white space before a space: the run stays together
                joined, parts = parts, []
                for p in joined:
                    if parts and (not parts[-1] or parts[-1][-1].isspace()):
                        parts[-1] += " " + p
                    else:
                        parts.append(p)
            spans.append(parts)
        start, later = self.known
        self.learn([p for p in {s[0] for s in spans} if p not in start], start, "")
        self.learn([p for p in set().union(*(s[1:] for s in spans)) if p not in later], later, " ")
        out = []
        for s in spans:
            w = np.fromiter(map(later.__getitem__, s[1:]), np.int64, len(s) - 1)
            w = np.concatenate(([start[s[0]]], w))
            out.append(gather(self.pool, self.first[w], self.count[w]))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(self.bytes, self.starts[ids], self.lengths[ids]).tobytes()


@lru_cache(2)
def tokenizer(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                ids = bpe.encode([t or "" for t in part.column(1).to_pylist()])
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat))], ["doc_id", "ids"])
        bpe.forget()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, data binary): the bytes of each row's ids; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            data = [None if x is None else bpe.decode(np.asarray(x, np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])

    return coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes in one pass: doc_id, packed (the ids as little-endian unsigned 32-bit
    integers, as token shards hold them), decoded (the bytes of the ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                ids = bpe.encode([t or "" for t in part.column(1).to_pylist()])
                columns = [part.column(0), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "packed", "decoded"])
        bpe.forget()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, packed binary, decoded binary")
