"""Corpus-wide removal of repeated lines.

Explode the normalised lines, hash them, count the distinct documents of each hash, drop the
lines of hashes over the threshold, put the rest back by position. Hashes are 128 bits (two
seeded 64-bit ones). The count is a partial aggregate, so a line that stands everywhere meets
as one row per task; repeated hashes are written out, and the join that marks lines is a
sort-merge join between plain shuffles, which adaptive execution splits when one is hot.

Defined results: a null or empty text is one empty line; a null id counts as one document
that comes after all others; repeated rows are one document and all lose or keep the same
lines; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._scratch import written
from ._text import BLANKS, ascii_lower, row_key

LAST = (1 << 63) - 1


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """``\\z``, not ``$``, which also matches before a last U+0085, U+2028 or U+2029."""
    return ascii_lower(F.regexp_replace(line, rf"\A{BLANKS}+|{BLANKS}+\z", ""))


def drop_repeated_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, kept_text, and with ``carry`` the
    input row as the struct ``row``.

    A key of ``min_chars`` code points or more found in ``min_docs`` documents or more keeps
    its lines in the smallest id that holds it and loses them elsewhere."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row")] if carry else []
    more = ["row"] * carry
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *row)
    base = base.select("doc_id", "text", *more, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), row_key(F.col("doc_id"), F.col("text")).alias("rk"))
    lines = (
        base.select("id", "rk", F.posexplode(F.transform(_lines(F.col("text")), line_key)).alias("pos", "line"))
        .filter(F.length("line") >= min_chars)
        .select("id", "rk", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))
    )
    if min_docs == 2:
        seen = lines.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    else:
        seen = lines.groupBy("h1", "h2", "id").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter(F.col("n") >= min_docs)
    repeated = written(seen.select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), "first"), "repeated-lines")
    marked = lines.hint("merge").join(repeated, (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")) & (F.col("id") != F.col("first")))
    drops = marked.groupBy("rk").agg(F.collect_set("pos").alias("gone"))  # of one document: as many as its lines at most
    out = base.join(drops.hint("merge"), "rk", "left").select("doc_id", *more, _lines(F.col("text")).alias("ls"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("ls") - 1), "gone")
    out = out.select("doc_id", *more, "ls", "gone", kept.alias("kept"))
    return out.select("doc_id", *more, F.size("ls").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"), F.expr("array_join(transform(kept, i -> ls[i]), '\n')").alias("kept_text"))


def without_repeated_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with its columns; the text is what is left, and ``length_col``, where there is one, its length."""
    out = drop_repeated_lines(docs, min_chars, min_docs, id_col, text_col, carry=True)
    kind = dict(docs.dtypes)
    columns = {text_col: F.col("kept_text")} | ({length_col: F.length("kept_text").cast(kind[length_col])} if length_col in kind else {})
    return out.select(*[columns.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
