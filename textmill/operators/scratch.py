"""Tables written between the rounds of an iteration, in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a folder of our own where that is unset and driver and tasks are one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("textmill: set spark.checkpoint.dir to a folder that driver and executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="textmill-"))
    return _OWN[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` from a table of its own: its lineage is cut, its size known, and no setting of the session changes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(small: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """A written table for a join: broadcast if its counted rows are few, else left to sort-merge joins."""
    return F.broadcast(small) if small.limit(most_rows + 1).count() <= most_rows else small.hint("merge")


def dealt(rows: DataFrame, *by: str, each: int = 4_000) -> DataFrame:
    """``rows`` dealt by ``by`` to partitions of about ``each`` rows. Without a number of its own Spark joins partitions until one or two are left for
    each core, and what a task holds of them grows with the table."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(cores, -(-rows.count() // max(1, each))), *by)
