"""Running values over a key whose rows are spread over all tasks: two-pass prefix scans.

Rows are dealt to ranges of (key, order) and written; each range is summed up a key; the sums of the ranges before it
are a key's offset; the running values inside a range are added to it. No task holds more than a range of
a key, so one key may hold all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .scratch import written

ORDER, TIE, RANGE = "_order", "_tie", "_range"


def _dealt(df: DataFrame, by: list[str], order: list[Column], values: dict[str, Column]) -> DataFrame:
    """``df`` with the columns of ``values`` and the number of the range each row stands in."""
    rows = df.withColumns(values).withColumn(TIE, F.monotonically_increasing_id())
    return written(rows.repartitionByRange(*by, *order, TIE).withColumn(RANGE, F.spark_partition_id()), "ranges")


def _joined(rows: DataFrame, ahead: DataFrame, by: list[str]) -> DataFrame:
    """Each row with what its key's earlier ranges come to; null keys are keys."""
    names = {b: f"_of_{i}" for i, b in enumerate([RANGE, *by])}
    ahead = ahead.withColumnsRenamed(names)
    on = F.lit(True)
    for b, n in names.items():
        on = on & F.col(b).eqNullSafe(F.col(n))
    return rows.join(ahead.hint("merge"), on).drop(*names.values())


def running(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column], before: bool = False) -> DataFrame:
    """``df`` with running sums, up to and with the row in ``order``, or ``before`` it. Nulls add nothing. Rows of equal order need a
    last column in ``order`` that tells them apart if it matters which comes first."""
    parts = {f"_part_{n}": F.coalesce(c, F.lit(0)) for n, c in sums.items()}
    rows = _dealt(df, by, order, parts)
    totals = rows.groupBy(RANGE, *by).agg(*[F.sum(p).alias(p) for p in parts])
    earlier = W.partitionBy(*by).orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)  # one row for each range of a key
    ahead = totals.select(RANGE, *by, *[F.coalesce(F.sum(p).over(earlier), F.lit(0)).alias(f"_ahead{p}") for p in parts])
    inside = W.partitionBy(RANGE, *by).orderBy(*order, TIE).rowsBetween(W.unboundedPreceding, -1 if before else 0)
    out = _joined(rows, ahead, by)
    return out.select(*df.columns, *[(F.col(f"_ahead_part_{n}") + F.coalesce(F.sum(f"_part_{n}").over(inside), F.lit(0))).alias(n) for n in sums])


def carried(df: DataFrame, by: list[str], order: list[Column], values: dict[str, Column]) -> DataFrame:
    """``df`` with, for each of ``values``, the last one that isn't null in the rows before."""
    parts = {f"_part_{n}": c for n, c in values.items()}
    rows = _dealt(df, by, order, parts)
    inside = W.partitionBy(RANGE, *by).orderBy(*order, TIE).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(RANGE, *by).orderBy(*order, TIE).rowsBetween(W.unboundedPreceding, 0)
    last = rows.withColumns({f"_run{p}": F.last(p, ignorenulls=True).over(whole) for p in parts}).withColumn("_place", F.row_number().over(W.partitionBy(RANGE, *by).orderBy(*order, TIE)))
    ends = last.groupBy(RANGE, *by).agg(*[F.max_by(f"_run{p}", "_place").alias(p) for p in parts])
    earlier = W.partitionBy(*by).orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
    ahead = ends.select(RANGE, *by, *[F.last(p, ignorenulls=True).over(earlier).alias(f"_ahead{p}") for p in parts])
    out = _joined(rows, ahead, by)
    return out.select(*df.columns, *[F.coalesce(F.last(f"_part_{n}", ignorenulls=True).over(inside), F.col(f"_ahead_part_{n}")).alias(n) for n in values])

