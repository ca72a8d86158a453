"""Counts, gauges, percentiles and feedback statistics."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .scratch import sized, written
from .spread import running


BINS = 1024


def _level(v: Column) -> Column:
    """A scale on which sizes, not differences, are spread; it keeps the order of values."""
    return F.signum(v) * (F.log(F.abs(v) + 1e-300) + 691)


def _narrowed(values: DataFrame, goals: DataFrame, by_size: bool) -> DataFrame:
    """One round: each goal (k, goal, rank, low, high) is the element at ``rank`` of its key's values from low to high;
    their histogram of `BINS` bins, equal in width or on the scale of sizes, tells in which bin it lies, and between which values."""
    held = goals.groupBy("k").agg(F.collect_list(F.struct("goal", "rank", "low", "high")).alias("goals"))  # a few goals a key
    rows = values.join(sized(held), values["k"].eqNullSafe(held["k"])).drop(held["k"])
    rows = rows.select("k", "v", F.explode("goals").alias("g")).filter("v BETWEEN g.low AND g.high")
    scale = _level if by_size else lambda v: v / 2  # halves: no difference overflows
    at, low, high = (scale(F.col(c)) for c in ("v", "g.low", "g.high"))
    share = F.coalesce(F.try_divide(at - low, high - low), F.lit(0.0))  # what the scale can't tell apart is one bin in this round
    bins = rows.groupBy("k", "g.goal", "g.rank", F.least(F.lit(BINS - 1), F.floor(share * BINS).cast("int")).alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
    end = F.sum("c").over(W.partitionBy("k", "goal").orderBy("bin").rowsBetween(W.unboundedPreceding, 0))  # `BINS` rows at most
    hit = bins.withColumn("end", end).filter((F.col("end") > F.col("rank")) & (F.col("end") - F.col("c") <= F.col("rank")))
    return hit.select("k", "goal", (F.col("rank") - F.col("end") + F.col("c")).alias("rank"), "low", "high")


def selected(df: DataFrame, by: str, value: str, goals: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(``by``, one column for each of ``goals``): exact order statistics of each key by distributed selection. A goal
    makes an index from the number of values. Rounds of histograms, counted in each task before the shuffle, narrow the range
    that each goal lies in until it is a single value; no sort, and no task that holds a key. Null, infinite and NaN values take no part."""
    v = F.col(value).cast("double")
    values = df.select(F.col(by).alias("k"), v.alias("v")).filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    base = values.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    first = F.explode(F.array(*[F.struct(F.lit(g).alias("goal"), of(F.col("n")).cast("long").alias("rank")) for g, of in goals.items()]))
    live, found, rounds = written(base.select("k", first.alias("g"), "low", "high").select("k", "g.*", "low", "high"), "percentiles"), [], 0
    while True:
        found.append(live.filter("low = high").select("k", "goal", "low"))
        live = live.filter("low < high")
        if live.isEmpty():
            break
        live = written(_narrowed(values, live, rounds % 2 == 1), "percentiles")
        rounds += 1
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy(F.col("k").alias(by)).agg(*[F.max(F.when(F.col("goal") == g, F.col("low"))).alias(g) for g in goals])


def ranked_percentiles(df: DataFrame, by: str, value: str, percents: list[int]) -> DataFrame:
    """The element at index int(n * p / 100), at most the last, of each group's sorted values.
    50 is the median: the mean of the two middle values if their number is even."""
    goals: dict[str, Callable[[Column], Column]] = {}
    for p in percents:
        if p == 50:
            goals |= {"m1": lambda n: F.floor((n - 1) / 2), "m2": lambda n: F.floor(n / 2)}
        else:
            goals[f"p{p}"] = lambda n, p=p: F.least(F.floor(n * p / 100), n - 1)
    got = selected(df, by, value, goals)
    return got.select(by, *[((F.col("m1") + F.col("m2")) / 2 if p == 50 else F.col(f"p{p}")).alias(f"p{p}") for p in percents])


def operation_stats(df: DataFrame, by: str, value: str, good: Column) -> DataFrame:
    """count, min, max, mean, median, p95, p99 and success_rate of each operation, 2 digits."""
    two = lambda c: F.round(c, 2)
    base = df.groupBy(by).agg(
        F.count("*").alias("n"), two(F.min(value)).alias("low"), two(F.max(value)).alias("high"),
        two(F.avg(value)).alias("mean"), two(F.sum(good.cast("int")) * 100 / F.count("*")).alias("success_rate"),
    )
    p = ranked_percentiles(df, by, value, [50, 95, 99])
    p = p.select(F.col(by).alias("_by"), *[two(F.col(c)).alias(c) for c in ("p50", "p95", "p99")])
    return base.hint("merge").join(p, base[by].eqNullSafe(p["_by"]), "left").drop("_by")  # few rows on both sides


def counters(df: DataFrame, by: str, value: str) -> DataFrame:
    return df.groupBy(by).agg(F.round(F.sum(value), 4).alias("total"))


def gauges(df: DataFrame, by: str, value: str, order: Column) -> DataFrame:
    """The last value of each name."""
    return df.groupBy(by).agg(F.max_by(value, order).alias("last"))


def running_mean(df: DataFrame, by: str, order: list[Column], value: str) -> DataFrame:
    """``df`` with mean_so_far; a key's rows may be spread over all tasks."""
    out = running(df, [by], order, {"_sum": F.col(value), "_n": F.col(value).isNotNull().cast("int")})
    return out.withColumn("mean_so_far", F.when(F.col("_n") > 0, F.round(F.col("_sum") / F.col("_n"), 9))).drop("_sum", "_n")


def success(df: DataFrame, by: list[str], accepted: Column, rejected: Column) -> DataFrame:
    a, r = F.count_if(accepted), F.count_if(rejected)
    return df.groupBy(*by).agg(a.alias("accepted"), r.alias("rejected"), F.round(F.when(a + r > 0, a * 100 / (a + r)).otherwise(0.0), 4).alias("success_rate"))


def fingerprint(files: DataFrame, by: str, path: Column, size: Column) -> DataFrame:
    """First 16 hex digits of the md5 of the sorted path:size list of each project."""
    listed = F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", path, size))), "|")
    return files.groupBy(by).agg(F.substring(F.md5(listed), 1, 16).alias("fingerprint"), F.count("*").alias("files"))
