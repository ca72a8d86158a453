"""Spelling variants: words one edit apart, each word's likely form, and the root of a chain of forms.

Words are counted in Spark (a partial aggregate: a row for each word and task is shuffled). A pair of words one edit apart agrees before and
after some segment of the shorter one, so words are dealt to buckets by what stands before and after each of their segments (`SEGMENT`
code points, at most `MOST_SEGMENTS` a word): no pair of near words is missed, whatever its bucket's size. A bucket of more
than ``tile`` words is cut into blocks, and each pair of blocks is a tile of its own.

In a tile, words are rows of two padded code-point matrices, one flush left and one flush right. Rows are compared densely: the
common prefix and the common suffix of a pair reach the longer length minus one exactly if one insertion, deletion or replacement
parts the two. A pair counts in the bucket of the segment where its common prefix ends and in no other, so nothing is counted twice and tasks
return one row a word, its number of near words and the best of them, never the pairs.

Forms are followed by pointer doubling; as a form occurs ``ratio`` times as often as its word, chains are short.

Defined results: null and empty texts have no words; a null id is written as an empty text before the colon; repeated rows count each time; ties
between near words go to the first in code-point order; an empty table gives an empty result; extra columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ._scratch import written
from ._text import ascii_lower

LETTERS = r"a-zÀ-ÿ"
SEGMENT, MOST_SEGMENTS = 3, 16
CELLS = 1 << 22  # code points in a matrix, or compared at once
KEYED = "b long, x int, y int, mine int, c int, i int, word string, n long"


def segments(c: int) -> tuple[int, int]:
    """Number and width of the segments of words of c code points."""
    width = max(SEGMENT, -(-c // MOST_SEGMENTS))
    return -(-c // width), width


def words(docs: DataFrame, every: int = 199, least_length: int = 6, least_count: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n). Runs of letters; where ``every`` divides the hash of id and run, a code point of the run goes."""
    # a word has at least ``least_length`` code points only if its run has
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(ascii_lower(F.col(text_col)), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))).alias("run"))
    h = runs.withColumn("h", F.crc32(F.concat("d", F.lit(":"), "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    got = h.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= least_length)
    return got.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _buckets(role: int, least_length: int) -> Column:
    """Buckets of a word of c = length - role code points, compared with words of c and c + 1."""
    c = F.length("word") - role
    width = F.greatest(F.lit(SEGMENT), F.ceil(c / MOST_SEGMENTS).cast("int"))
    last = F.ceil(c / width).cast("int") - 1

    def of(i: Column) -> Column:
        after = c - F.least((i + 1) * width, c)
        key = F.xxhash64(c, i, F.col("word").substr(F.lit(1), i * width), F.col("word").substr(F.length("word") - after + 1, after))
        return F.struct(key.alias("b"), c.cast("int").alias("c"), i.cast("int").alias("i"))

    return F.when(c >= least_length, F.transform(F.sequence(F.lit(0), last), of)).otherwise(F.array())


def tiles(vocabulary: DataFrame, tile: int, least_length: int) -> DataFrame:
    """(b, x, y, mine, c, i, word, n): the words of each pair of blocks x <= y of bucket b; a word stands in block ``mine``."""
    keyed = vocabulary.select("word", "n", F.explode(F.concat(_buckets(0, least_length), _buckets(1, least_length))).alias("k")).select("k.*", "word", "n")
    size = F.count("*").over(W.partitionBy("b", "c", "i"))
    room = F.greatest(F.lit(2), F.least(F.lit(tile), F.expr(f"{CELLS} div c"))).cast("int")
    blocks = keyed.withColumn("size", size).filter("size > 1").withColumn("blocks", F.ceil(F.col("size") / room).cast("int"))
    mine = blocks.withColumn("mine", F.pmod(F.xxhash64("word"), "blocks").cast("int"))
    dealt = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("b", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "c", "i", "word", "n")


def _matrices(texts: list[str], lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    at = np.arange(width)
    left, right = np.zeros((2, len(texts), width), np.uint32)
    left[at < lengths[:, None]] = points
    right[at >= width - lengths[:, None]] = points
    return left, right


def _pairs(sizes: np.ndarray, firsts: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of each group of ``sizes`` neighbouring rows, about ``most`` at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0
    for d in range(1, int(sizes.max(initial=1))):
        groups = sizes > d
        rows = np.repeat(firsts[groups], sizes[groups] - d) + _inside(sizes[groups] - d)
        for k in range(0, len(rows), most):
            part = rows[k : k + most]
            held.append((part, part + d))
            count += len(part)
            if count >= most:
                yield tuple(np.concatenate(x) for x in zip(*held))
                held, count = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _inside(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the groups."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def near_of(run: pd.DataFrame) -> pd.DataFrame:
    """(word, near, best_n, best) of whole tiles of one c: number of near words and the best of them in these tiles."""
    c = int(run["c"].iloc[0])
    texts, n = run["word"].tolist(), run["n"].to_numpy()
    lengths = np.array([len(t) for t in texts])
    left, right = _matrices(texts, lengths, c + 1)
    ids = run[["b", "i", "x", "y"]].to_numpy()
    new = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]).any(axis=1)])
    sizes = np.diff(np.r_[new, len(run)])
    mine, i, split = run["mine"].to_numpy(), run["i"].to_numpy(), (run["x"] != run["y"]).to_numpy()
    width = segments(c)[1]
    from_, to = [], []
    for p, q in _pairs(sizes, new, max(1, CELLS // (c + 1))):
        keep = ((lengths[p] == c) | (lengths[q] == c)) & (~split[p] | (mine[p] != mine[q]))
        p, q = p[keep], q[keep]
        other = left[p] != left[q]
        prefix = np.where(other.any(axis=1), other.argmax(axis=1), c + 1)
        other = right[p][:, ::-1] != right[q][:, ::-1]
        suffix = np.where(other.any(axis=1), other.argmax(axis=1), c + 1)
        longer = np.maximum(lengths[p], lengths[q])
        near = (prefix <= longer - 1) & (prefix + suffix >= longer - 1) & (np.minimum(prefix, c - 1) // width == i[p])
        from_ += [p[near], q[near]]
        to += [q[near], p[near]]
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (from_, to))
    rank = np.empty(len(texts), np.int64)
    rank[sorted(range(len(texts)), key=texts.__getitem__)] = np.arange(len(texts))
    order = np.lexsort((rank[b], -n[b], a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[first, len(a)])
    of = lambda x: pd.Series([texts[k] for k in x[first]], dtype=object)
    return pd.DataFrame({"word": of(a), "near": counts.astype(np.int64), "best_n": n[b[first]], "best": of(b)})


def _near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by c and tile; whole tiles go on together as long as their matrix stays within `CELLS`."""
    rest: pd.DataFrame | None = None
    for batch in batches:
        rest = batch if rest is None or rest.empty else pd.concat([rest, batch], ignore_index=True)
        ids = rest[["c", "b", "i", "x", "y"]].to_numpy()
        ends = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
        done = 0
        for end, following in zip(ends, np.r_[ends[1:], 0]):  # the last tile may go on in the next batch
            c = ids[end - 1, 0]
            if not following or ids[following - 1, 0] != c or (following - done) * (c + 1) > CELLS:
                yield near_of(rest.iloc[done:end])
                done = end
        rest = rest.iloc[done:]
    if rest is not None and not rest.empty:
        yield near_of(rest)


def near_words(vocabulary: DataFrame, least_length: int = 6, tile: int = 512) -> DataFrame:
    """(word, n_near, best_n, best) of the words that have near ones."""
    dealt = tiles(vocabulary, tile, least_length).repartition("b", "c", "i", "x", "y").sortWithinPartitions("c", "b", "i", "x", "y")
    found = dealt.mapInPandas(_near, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.w").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word of (word, form): each round doubles the steps taken."""
    at = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = at.join(on.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = written(moved, "spelling-roots")
        at = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return at


def variants(docs: DataFrame, every: int = 199, least_length: int = 6, least_count: int = 5, ratio: int = 5, tile: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    vocabulary = written(words(docs, every, least_length, least_count, id_col, text_col), "spelling-words")
    near = written(near_words(vocabulary, least_length, tile), "spelling-near")
    known = vocabulary.join(near.hint("merge"), "word", "left")
    has = F.col("best_n") >= ratio * F.col("n")
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n"))
    known = written(known, "spelling-forms")
    last = roots(known.filter(F.col("form").isNotNull()).select("word", "form"))
    out = known.join(last.hint("merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
