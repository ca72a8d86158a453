"""Column helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = r"[\x20\x09-\x0D]"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def row_key(doc_id: Column, text: Column) -> Column:
    """A key that is the same for repeated rows and differs between texts under one id."""
    return F.struct(F.coalesce(doc_id.cast("string"), F.lit("")).alias("i"), F.xxhash64(text).alias("t"))


def slices(batch: pa.RecordBatch, column: int, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows with about ``most`` bytes of text, so that a task's memory follows
    this bound and the longest single text, not the Arrow batch."""
    size = pc.binary_length(batch.column(column)).to_pylist()
    start = held = 0
    for i, n in enumerate(size):
        if i > start and held + (n or 0) > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n or 0
    if len(size) > start:
        yield batch.slice(start)


def kept_rows(docs: DataFrame, text_col: str, test: Callable[[], Callable[[list[str]], list[bool]]]) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text passes. ``test`` makes the function
    that looks at texts once in each task; nothing is shuffled."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = test()
        for batch in batches:
            for part in slices(batch, at, 1 << 19):
                yield part.filter(pa.array(passes([t or "" for t in part.column(at).to_pylist()]), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
