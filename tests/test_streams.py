"""Streams over several micro-batches give the rows of their batch queries."""

import json

import pytest
from pyspark.sql import functions as F

from textmill.operators import search, windows
from textmill.plans import events as E
from textmill.streaming import streams

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


@pytest.fixture
def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def landed(spark, events, folder, cuts=4, after=()):
    """Files in the order of time, then those of ``after``; a micro-batch each."""
    span = events.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    step = (span.b - span.a) / cuts
    parts = [events.filter((F.col("ts") >= span.a + k * step) & ((F.col("ts") < span.a + (k + 1) * step) if k < cuts - 1 else F.lit(True))) for k in range(cuts)]
    for part in [*parts, *after]:
        part.coalesce(1).write.mode("append").parquet(folder)
    return streams.event_stream(spark, folder, events.schema, "10 minutes", 1)


def later(events, days, **columns):
    """One row some days after the last one, which moves the watermark on."""
    row = events.orderBy(F.desc("ts")).limit(1).withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {days} DAYS"))
    return row.withColumns({k: F.lit(v) for k, v in columns.items()})


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def finished(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name), [json.loads(p.json) for p in q.recentProgress]


def test_sessions_equal_batch(spark, events, tmp_path):
    stream = landed(spark, events, str(tmp_path / "e"), after=[later(events, 2, event_id=10**6)])
    got, progress = finished(streams.sessions(stream), "sessions")
    want = windows.sessions(events).select("user_id", "start_ts", "n")
    assert len(progress) > 4 and rows(got.select("user_id", "start_ts", "n")) == rows(want)


def test_pairs_of_starts_and_ends_equal_batch_and_leave_no_state(spark, events, tmp_path):
    last = [later(events, 30, event_id=10**6 + i, event_type=t, props='{"k": -%d}' % i) for i, t in enumerate(["view", "purchase"])]
    late = later(events, -20, event_id=10**7, event_type="purchase")  # far behind the watermark by then
    stream = landed(spark, events, str(tmp_path / "e"), after=[last[0].unionByName(last[1]), late])
    ops = E.operations(stream)
    got, progress = finished(streams.paired(ops.filter("event_type = 'view'"), ops.filter("event_type = 'purchase'"), "7 DAYS"), "pairs")
    e = E.operations(events)
    want = windows.paired(e.filter("event_type = 'view'"), e.filter("event_type = 'purchase'"), 7 * 24 * 3600)
    assert rows(got) == rows(want) and want.count() > 0
    state = [o for o in progress[-1]["stateOperators"]]
    assert sum(o["numRowsTotal"] for o in state) <= 4  # the two rows that moved the watermark on, with their keys
    assert sum(o["numRowsDroppedByWatermark"] for p in progress for o in p["stateOperators"]) >= 1


@pytest.mark.parametrize("n, seconds, newest", [(3, 600, False), (2, 86400, False), (5, 86400, True)])
def test_caps_in_state_equal_batch(spark, events, tmp_path, n, seconds, newest):
    stream = landed(spark, events, str(tmp_path / "e"), after=[later(events, 3, event_id=10**6)])
    got, progress = finished(streams.capped(stream, n, seconds, newest), f"capped_{n}_{seconds}")
    cycle = F.floor(F.unix_seconds("ts") / seconds) * seconds
    order = [F.desc("ts"), F.desc("event_id")] if newest else [F.col("ts"), F.col("event_id")]
    want = windows.last_n(events.withColumn("cycle", cycle), ["cycle"], order, n).select("cycle", "event_id")
    assert len(progress) > 4 and rows(got) == rows(want)


def test_histories_in_state_equal_batch(spark, tmp_path):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    for k in range(3):
        turns.filter(F.col("turn") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "c"))
    stream = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "c"))
    got, progress = finished(streams.history(stream, 2), "histories", "update")
    got = got.collect()
    last = {r.conv_id: r.seen for r in sorted(got, key=lambda r: r.seen)}
    want = windows.last_n(turns, ["conv_id"], [F.desc("turn")], 2).select("conv_id", "turn", "role", "text")
    kept = sorted(((r.conv_id, r.turn, r.role, r.text) for r in got if r.seen == last[r.conv_id]), key=repr)
    assert len(progress) >= 3 and kept == rows(want)


def test_cooldown_equals_batch(spark, events, tmp_path):
    stream = landed(spark, events, str(tmp_path / "e"))
    got, progress = finished(streams.cooldown(stream, 6 * 3600), "cooled")
    want = windows.cooled(events.select("event_id", "user_id", "ts"), 6 * 3600)
    assert len(progress) >= 4 and rows(got.select("event_id")) == rows(want.select("event_id"))


def test_compaction_leaves_the_index_of_the_pages_as_they_are(spark, tmp_path):
    days = [{1: "alpha beta words", 2: "gamma delta words", 3: "same text stays"}, {1: "alpha changed now", 4: "epsilon comes new"}, {1: "alpha beta words", 2: "gamma delta words"}, {4: "epsilon goes away", 5: "last one here"}]
    folder = {n: str(tmp_path / n) for n in ("in", "store", "posts", "gone", "check")}

    def tokens(d):
        return search.postings(d, "page_id", "content").withColumnRenamed("id", "page_id")

    def index(posts):
        return rows(posts.select("page_id", "token", "tf"))

    def ingest(day):
        spark.createDataFrame(list(day.items()), "page_id long, content string").coalesce(1).write.mode("append").parquet(folder["in"])
        landed_ = spark.readStream.schema("page_id long, content string").parquet(folder["in"])
        streams.ingest(landed_, lambda b: b, folder["store"], folder["posts"], folder["check"], tokens, "page_id", folder["gone"]).awaitTermination()

    now = {}
    for day in days[:3]:
        now |= day
        ingest(day)
    fresh = index(tokens(spark.createDataFrame(list(now.items()), "page_id long, content string")))
    before = spark.read.parquet(folder["posts"])
    assert index(before) != fresh
    assert index(streams.current(before, spark.read.parquet(folder["store"]), "page_id")) == fresh
    assert streams.compact(spark, folder["posts"], folder["gone"], "page_id") == 2
    assert index(spark.read.parquet(folder["posts"])) == fresh
    assert streams.compact(spark, folder["posts"], folder["gone"], "page_id") == 0
    ingest(days[3])  # parts of which nothing is left go as well
    now |= days[3]
    streams.compact(spark, folder["posts"], folder["gone"], "page_id")
    assert index(spark.read.parquet(folder["posts"])) == index(tokens(spark.createDataFrame(list(now.items()), "page_id long, content string")))
