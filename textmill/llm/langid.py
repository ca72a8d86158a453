"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's features are its character 2- and 3-grams (letters in lower case, everything else one
space), hashed into ``buckets`` rows of an embedding table. Table and softmax are trained together
by stochastic gradient descent in numpy, on a bounded sample: ``per_class`` documents of each
language at most and ``most_rows`` in all, the first by a hash of the id; of more than ``most_labels`` languages
those with most documents are learned. Tasks turn the sample's texts into feature shares; the
driver gets these numbers, never a text. On a part of the sample kept back, a temperature
is fitted, so that scores are probabilities, and a score below which predictions are rejected:
three quarters of the way, in log-odds, from chance to what all but a ``reject`` share of those texts reach.
As the softmax is linear in the average, the tasks get one row of class scores a bucket.

Defined results: null texts and texts without a letter are ``und`` with score 0 and are rejected;
rows with a null language aren't learned from; with no row to learn from all is ``und`` with score 0,
and only texts without a letter are rejected; repeated rows get equal results; a null id is predicted like any other and stays null; an empty table gives
an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ._text import kept_rows, slices

BUCKETS = 1 << 16
SCHEMA = "doc_id long, lang_pred string, score double, rejected boolean"


@lru_cache(1)
def _folding() -> np.ndarray:
    """Code point -> lower case letter, else 32."""
    out = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def features(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all texts, text after text, and where each text's begin. A text
    without letters has none."""
    if not texts:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    points = _folding()[np.frombuffer("".join(f" {t}\n" for t in texts).encode("utf-32-le"), np.uint32)]
    ends = np.cumsum([len(t) + 2 for t in texts])  # each text stands between white space
    doc = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    keep = points != 32
    keep[1:] |= ~keep[1:] & (points[:-1] != 32)
    keep[np.concatenate(([0], ends[:-1]))] = True
    points, doc = points[keep].astype(np.uint32), doc[keep]
    two = (points[:-1] * np.uint32(0x85EBCA6B)) ^ (points[1:] * np.uint32(0xC2B2AE35))
    three = (two[:-1] * np.uint32(0x27D4EB2F)) ^ (points[2:] * np.uint32(0x9E3779B1))
    shift = np.uint32(32 - buckets.bit_length() + 1)
    letters = (points[:-1] != 32) | (points[1:] != 32)
    same2, same3 = (doc[:-1] == doc[1:]) & letters, doc[:-2] == doc[2:]
    same3 &= letters[:-1] | letters[1:]
    of = np.concatenate((doc[:-1][same2], doc[:-2][same3]))
    got = np.concatenate((((two * np.uint32(0x165667B1)) >> shift)[same2], ((three * np.uint32(0xD3A2646D)) >> shift)[same3])).astype(np.int64)
    order = np.argsort(of, kind="stable")
    return got[order], np.searchsorted(of[order], np.arange(len(texts) + 1))


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # buckets x labels: log-odds of a text are the mean over its features
    bias: np.ndarray
    temperature: float
    threshold: float

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[bool]]:
        found, first = features(texts, len(self.table))
        n = np.diff(first) if len(texts) else np.zeros(0, np.int64)
        if not len(self.labels):
            return ["und"] * len(texts), [0.0] * len(texts), (n == 0).tolist()
        odds = np.empty((len(texts), len(self.labels)))
        for c in range(len(self.labels)):
            sums = np.concatenate(([0.0], np.cumsum(self.table[:, c][found])))
            odds[:, c] = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(n, 1) + self.bias[c]
        p = _softmax(odds / self.temperature)
        best = p.argmax(axis=1)
        score = np.where(n > 0, p[np.arange(len(texts)), best], 0.0)
        return [self.labels[b] if k else "und" for b, k in zip(best, n)], score.tolist(), (score < self.threshold).tolist()


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


Shares = tuple[np.ndarray, np.ndarray]  # distinct features of one text and the share of each


def shares(text: str, buckets: int) -> Shares:
    found = features([text], buckets)[0]
    seen, n = np.unique(found, return_counts=True)
    return seen.astype(np.int32), (n / max(1, len(found))).astype(np.float32)


def train(rows: list[Shares], langs: list[str], buckets: int = BUCKETS, dim: int = 12, epochs: int = 12, batch: int = 64, rate: float = 2.0, seed: int = 7, reject: float = 0.001) -> Model:
    labels = sorted(set(langs))
    if not labels:
        return Model([], np.zeros((buckets, 0)), np.zeros(0), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    table, weights, bias = rng.normal(0, 1 / dim, (buckets, dim)), np.zeros((dim, len(labels))), np.zeros(len(labels))
    weights += rng.normal(0, 0.1, weights.shape)
    y = np.array([labels.index(x) for x in langs])
    usable = np.array([i for i in rng.permutation(len(rows)) if len(rows[i][0])], np.int64)
    back = usable[: len(usable) // 5]
    learn = usable[len(back) :] if len(usable) > 1 else usable

    def gathered(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        u, w = np.concatenate([rows[i][0] for i in part]), np.concatenate([rows[i][1] for i in part])
        size = np.array([len(rows[i][0]) for i in part])
        start = np.cumsum(size) - size
        return u, w, size, np.add.reduceat(table[u] * w[:, None], start, axis=0)

    for e in range(epochs):
        step = rate * (1 - e / epochs)
        for part in np.array_split(rng.permutation(learn), max(1, len(learn) // batch)) if len(learn) else ():
            u, w, size, mean = gathered(part)
            error = _softmax(mean @ weights + bias)
            error[np.arange(len(part)), y[part]] -= 1
            error /= len(part)
            down = np.repeat(error @ weights.T, size, axis=0) * w[:, None]
            weights -= step * mean.T @ error
            bias -= step * error.sum(axis=0)
            for d in range(dim):
                table[:, d] -= step * 50 * np.bincount(u, down[:, d], buckets)  # a bucket is seen seldom
    parts = np.array_split(back, -(-len(back) // batch)) if len(back) else []
    odds = np.concatenate([np.zeros((0, len(labels))), *(gathered(part)[3] @ weights + bias for part in parts)])

    def loss(t: float) -> float:  # a hundredth of the weight on all classes alike keeps certainty finite where no text was mistaken
        logs = np.log(_softmax(odds / t) + 1e-12)
        return -(0.99 * logs[np.arange(len(back)), y[back]] + 0.01 * logs.mean(axis=1)).mean()

    temperature = min((2.0**x for x in np.arange(-5, 3.25, 0.25)), key=loss) if len(back) else 1.0
    sure = _softmax(odds / temperature).max(axis=1) if len(back) else np.full(1, 0.5)
    usual, chance = np.clip([np.quantile(sure, reject), 1 / len(labels)], 1e-6, 1 - 1e-6)
    threshold = float(1 / (1 + (1 / usual - 1) ** 0.75 * (1 / chance - 1) ** 0.25))
    return Model(labels, table @ weights, bias, float(temperature), threshold)


def held_out(doc_id: Column) -> Column:
    """Fold 2 of 4 by crc32 of the id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sampled(sample: DataFrame, buckets: int) -> pa.Table:
    """(i, lang, h, seen, share) of the rows (i, lang, h, t): what training needs of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 3, 1 << 19):
                got = [shares(t or "", buckets) for t in part.column(3).to_pylist()]
                seen, share = (pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(g[0]) for g in got]), pa.int32()), pa.array(np.concatenate([g[x] for g in got]), kind)) for x, kind in ((0, pa.int32()), (1, pa.float32())))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), seen, share], ["i", "lang", "h", "seen", "share"])

    return sample.select("i", "lang", "h", "t").mapInArrow(run, f"i {sample.schema['i'].dataType.simpleString()}, lang string, h long, seen array<int>, share array<float>").toArrow()


def fit(docs: DataFrame, per_class: int = 300, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_rows: int = 4000, most_labels: int = 64) -> Model:
    """Trains on at most ``per_class`` rows of each language outside the held-out fold, ``most_rows`` in all."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(lang_col).alias("lang"), F.col(text_col).alias("t")).filter(F.col("lang").isNotNull() & F.col("i").isNotNull() & ~held_out(F.col("i")))
    largest = [r.lang for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_labels).collect()]
    if not largest:
        return train([], [])
    rows = rows.filter(F.col("lang").isin(largest))
    most = min(per_class, max(1, most_rows // len(largest)))

    def first(df: DataFrame, *order: Column) -> DataFrame:
        rank = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("i"), "i", *order))  # each task keeps its first rows only, before the shuffle
        return df.withColumn("r", rank).filter(F.col("r") <= most).drop("r")

    # ids first, so that texts of few rows only are shuffled; a chosen id may stand in many rows, so the rows are ranked again
    ids = first(rows.drop("t")).select("i").distinct().collect()
    chosen = rows.join(F.broadcast(docs.sparkSession.createDataFrame(ids, rows.select("i").schema)), "i", "left_semi")
    got = _sampled(first(chosen.withColumn("h", F.xxhash64("t")), F.col("h")), BUCKETS).sort_by([("i", "ascending"), ("lang", "ascending"), ("h", "ascending")])
    values = [(a.values.to_numpy(), b.values.to_numpy()) for a, b in zip(got["seen"], got["share"])]
    return train(values, got["lang"].to_pylist())


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 1 << 19):
                lang, score, bad = shared.value.predict([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bad, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, that ``model`` doesn't reject."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return kept_rows(docs, text_col, lambda: lambda texts: [not bad for bad in shared.value.predict(texts)[2]])
