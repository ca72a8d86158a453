"""Sinks: adjacency, knowledge files, compressed stores, metrics and spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def adjacency(edges: DataFrame, path: str) -> None:
    edges.groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("dependencies")).write.mode("overwrite").json(path)


def knowledge(docs: DataFrame, path: str, source: str = "source", body: str = "text", force: bool = False) -> None:
    """Front matter and body as text, a folder for each source; left alone where it is, unless forced."""
    front = F.concat(F.lit("---\nsource: "), F.col(source), F.lit("\n---\n"), F.col(body))
    docs.select(F.col(source).alias("source"), front.alias("value")).write.mode("overwrite" if force else "ignore").partitionBy("source").text(path)


def store(docs: DataFrame, path: str, text: str = "text") -> None:
    docs.withColumn("original_bytes", F.octet_length(text)).write.mode("append").option("compression", "zstd").parquet(path)


def metrics(counters: DataFrame, gauges: DataFrame, stats: DataFrame, path: str) -> None:
    """One table: what (counter, gauge, statistic), name, values as JSON."""
    tagged = lambda df, what: df.select(F.lit(what).alias("what"), F.to_json(F.struct(*df.columns)).alias("record"))
    tagged(counters, "counter").unionByName(tagged(gauges, "gauge")).unionByName(tagged(stats, "statistic")).write.mode("overwrite").parquet(path)


def spans(df: DataFrame, path: str, trace_id: str | None = None) -> None:
    (df.filter(F.col("trace_id") == trace_id) if trace_id else df).write.mode("overwrite").json(path)


def upserted(old: DataFrame, new: DataFrame, key: str, order: Column) -> DataFrame:
    """The last row of each key of both."""
    both = old.unionByName(new)
    return both.groupBy(key).agg(F.max_by(F.struct(*both.columns), order).alias("r")).select("r.*")
