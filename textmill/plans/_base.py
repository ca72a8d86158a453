"""What the query modules share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    """Queries by name, and their SQL where there is one."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def put(query: Query) -> Query:
            self.queries[name] = query
            if sql:
                self.sql[name] = sql
            return query

        return put

    def columns(self, name: str, table: str, key: list[str], spark_columns: Callable[[], dict[str, Column]], sql: str) -> None:
        """A query of column expressions over a table: its key columns and the named ones."""
        self.queries[name] = lambda spark, d: read(spark, d, table).select(*key, *[c.alias(n) for n, c in spark_columns().items()])
        self.sql[name] = sql


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def quoted(word: str) -> str:
    return "'" + word.replace("'", "''") + "'"


def sql_any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), {quoted(w)})" for w in words) + ")"


def sql_hits(text: str, words: list[str]) -> str:
    return "(" + " + ".join(f"contains(lower({text}), {quoted(w)})::INT" for w in words) + ")"


def sql_first(text: str, table: dict[str, list[str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {sql_any(text, w)} THEN '{n}'" for n, w in table.items()) + f" ELSE '{default}' END"


__all__ = ["Catalog", "Column", "DataFrame", "F", "Query", "SparkSession", "quoted", "read", "sql_any", "sql_first", "sql_hits"]
