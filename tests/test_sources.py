"""Pluggable sources, handlers inside a stream, postings of changed pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from textmill.operators.feedback import Handlers
from textmill.sources import pluggable
from textmill.streaming import streams


def test_a_function_becomes_a_table(spark):
    pluggable.register(spark, "letters", "unit string, n int", ["a", "b"], lambda unit: ((unit, i) for i in range(3)))
    df = spark.read.format("letters").load()
    assert df.rdd.getNumPartitions() == 2
    assert sorted(map(tuple, df.collect())) == [(u, i) for u in "ab" for i in range(3)]


def test_registry_lookups(spark):
    reg = spark.createDataFrame([("x", "docs", "high"), ("y", "docs", "low"), ("z", "news", "high")], "name string, category string, priority string")
    names = lambda df: sorted(r.name for r in df.collect())
    assert names(pluggable.chosen(reg)) == ["x", "y", "z"]
    assert names(pluggable.chosen(reg, category="docs")) == ["x", "y"]
    assert names(pluggable.chosen(reg, "docs", "high")) == ["x"]


def test_entries_without_extract_or_repeated_go(spark):
    rows = spark.createDataFrame([("t", "s", "e"), ("t", "s", "e"), ("t", "s", None), ("u", "s", " "), ("u", "s", "e")], "topic string, source string, extract string")
    assert sorted(r.topic for r in pluggable.entries(rows).collect()) == ["t", "u"]


def test_handlers_run_inside_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, "up", "a"), (2, "none", "b"), (3, "twice", "c")], "id int, handler string, text string").write.parquet(str(tmp_path / "in"))
    h = Handlers(default="twice")
    h.register("up", lambda df: df.select("id", F.upper("text").alias("answer")), kind="case")
    h.register("twice", lambda df: df.select("id", F.concat("text", "text").alias("answer")), kind="copy")
    assert h.names() == ["up", "twice"] and h.names(kind="copy") == ["twice"]
    stream = spark.readStream.schema("id int, handler string, text string").parquet(str(tmp_path / "in"))
    streams.handled(stream, h, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert {(r.id, r.answer) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, "A"), (2, "bb"), (3, "cc")}


def test_postings_of_a_changed_page_go(spark):
    store = spark.createDataFrame([("u", 0), ("u", 1), ("v", 0)], "url string, batch int")
    postings = spark.createDataFrame([("u", 0, "old"), ("u", 1, "new"), ("v", 0, "same")], "url string, batch int, token string")
    assert sorted(r.token for r in streams.current(postings, store).collect()) == ["new", "same"]
