"""Sources that a user's function fetches, as tables that Spark reads in parallel."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def register(spark: SparkSession, name: str, schema: str, units: list[str], fetch: Callable[[str], Iterator[tuple]]) -> None:
    """Registers ``name`` for spark.read.format(name).load(). Each unit (a category, a shard, a feed) is one partition;
    ``fetch`` runs in its task and yields rows of ``schema``. A lost task fetches its unit again."""

    class Reader(DataSourceReader):
        def partitions(self):
            return [InputPartition(u) for u in units]

        def read(self, partition):
            yield from fetch(partition.value)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader()

    spark.dataSource.register(Source)


def chosen(registry: DataFrame, category: str | None = None, priority: str | None = None) -> DataFrame:
    """The rows of a registry of sources with a category, a priority, or both."""
    asked = {"category": category, "priority": priority}
    for column, value in asked.items():
        if value is not None:
            registry = registry.filter(F.col(column) == value)
    return registry


def entry_content(topic: Column, source: Column, extract: Column) -> Column:
    """One text of an encyclopedia entry; null where the extract is null or blank."""
    return F.when(F.length(F.trim(extract)) > 0, F.concat_ws("\n", F.concat(F.lit("Topic: "), topic), F.concat(F.lit("Source: "), source), F.lit(""), extract))


def entries(rows: DataFrame) -> DataFrame:
    """rows(topic, source, extract) -> one row a content with its md5; rows without an extract go, and of equal contents one stays."""
    out = rows.select("topic", "source", entry_content(F.col("topic"), F.col("source"), F.col("extract")).alias("content")).filter("content IS NOT NULL")
    return out.withColumn("hash", F.md5("content")).dropDuplicates(["hash"])
