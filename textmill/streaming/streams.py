"""Continuous forms: ingest cycles, cooldown, sessions, pairs of starts and ends, capped queues and histories,
rolling metrics, pattern learning, ingest and compaction.

Every stream casts its event time to a time-zone timestamp under UTC, as watermarks ask for it, and
keeps state bounded by a watermark or a time to live."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.feedback import Handlers, learn
from ..operators.scratch import written


def event_stream(spark: SparkSession, path: str, schema, delay: str = "10 minutes", files_per_trigger: int = 1000) -> DataFrame:
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return df.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def sessions(events: DataFrame, gap: str = "5 minutes", by: str = "user_id") -> DataFrame:
    """Sessions by inactivity; emitted when the watermark has passed their end."""
    s = events.groupBy(by, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select(by, F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "n")


def rolling_metrics(events: DataFrame, window: str = "1 hour", by: str = "event_type", value: str = "value") -> DataFrame:
    g = events.groupBy(F.window("ts", window).alias("w"), by)
    out = g.agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"), F.percentile_approx(value, 0.95).alias("p95"))
    return out.select(F.col("w.start").alias("start_ts"), by, "n", "low", "high", "mean", "p95")


def cooldown(events: DataFrame, seconds: int, by: str = "user_id") -> DataFrame:
    """Rows accepted if more than ``seconds`` passed since the key's last accepted one. The state is that
    time; it goes when no event of the key can be refused any more."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        last = state.get[0] if state.exists else None
        keep = []
        for t in rows["ts"]:
            us = int(t.value // 1000)
            good = last is None or us - last > seconds * 1_000_000
            keep.append(good)
            last = us if good else last
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield rows[keep][[by, "event_id", "ts"]]

    return events.groupBy(by).applyInPandasWithState(step, f"{by} long, event_id long, ts timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def paired(starts: DataFrame, ends: DataFrame, within: str = "1 hour", by: str = "op") -> DataFrame:
    """Starts and ends (``by``, event_id, ts, each with a watermark) of one operation, the end at most ``within`` after the start:
    (``by``, start_id, end_id, micros). Either side may come first. A row that is later than its side's watermark is dropped, and
    a row that can meet none any more leaves the state, as the join bounds the times on both sides."""
    s = starts.select(F.col(by), F.col("event_id").alias("start_id"), F.col("ts").alias("start_ts"))
    e = ends.select(F.col(by).alias("_by"), F.col("event_id").alias("end_id"), F.col("ts").alias("end_ts"))
    met = s.join(e, (F.col(by) == F.col("_by")) & (F.col("end_ts") >= F.col("start_ts")) & (F.col("end_ts") <= F.col("start_ts") + F.expr(f"INTERVAL {within}")))
    return met.select(by, "start_id", "end_id", (F.unix_micros("end_ts") - F.unix_micros("start_ts")).alias("micros"))


class _Capped(StatefulProcessor):
    """Keeps ``n`` rows (ts, event_id) of a cycle in list state, the oldest or the newest, and gives them out when its timer fires."""

    def __init__(self, n: int, newest: bool, seconds: int):
        self.n, self.newest, self.seconds = n, newest, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", "us long, event_id long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = list(self.kept.get())
        for part in rows:
            held += [(int(t.value // 1000), int(i)) for t, i in zip(part["ts"], part["event_id"])]
            held = sorted(held, reverse=self.newest)[: self.n]
        self.kept.put(held)
        self.handle.registerTimer((key[0] + self.seconds) * 1000)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held = list(self.kept.get())
        self.kept.clear()
        yield pd.DataFrame({"cycle": [key[0]] * len(held), "event_id": [i for _, i in held]})

    def close(self) -> None:
        pass


def capped(events: DataFrame, n: int, seconds: int, newest: bool = False) -> DataFrame:
    """(cycle, event_id): the first ``n`` events of each cycle of ``seconds``, or the ``newest`` ones (a bounded queue that drops
    the oldest). A cycle comes out once the watermark has passed its end; events that come later are dropped. The session
    needs the RocksDB state store."""
    cycles = events.withColumn("cycle", F.floor(F.unix_seconds("ts") / seconds) * seconds)
    return cycles.groupBy("cycle").transformWithStateInPandas(_Capped(n, newest, seconds), "cycle long, event_id long", "Append", "EventTime")


class _History(StatefulProcessor):
    """The last ``n`` turns of a conversation in list state."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getListState("turns", "turn long, role string, text string")
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held, seen = list(self.turns.get()), self.seen.get()[0] if self.seen.exists() else 0
        for part in rows:
            seen += len(part)
            held += [(int(t), r, x) for t, r, x in zip(part["turn"], part["role"], part["text"])]
            held = sorted(held, key=lambda h: h[0])[-self.n :]
        self.turns.put(held)
        self.seen.update((seen,))
        turn, role, text = zip(*held)
        yield pd.DataFrame({"conv_id": [key[0]] * len(held), "seen": [seen] * len(held), "turn": turn, "role": pd.Series(role, dtype=object), "text": pd.Series(text, dtype=object)})

    def close(self) -> None:
        pass


def history(turns: DataFrame, n: int) -> DataFrame:
    """The last ``n`` turns of a conversation after every batch that adds to it, with the number of turns seen: of a
    conversation's rows those with the largest ``seen`` hold. The session needs the RocksDB state store."""
    return turns.groupBy("conv_id").transformWithStateInPandas(_History(n), "conv_id long, seen long, turn long, role string, text string", "Update", "None")


def pattern_learning(feedback: DataFrame, keep: int = 20) -> DataFrame:
    """The patterns of each category after every batch of accepted feedback (category, event_id, keywords)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        words, counts = state.get if state.exists else ([], [])
        patterns = [{"keywords": set(w), "count": c} for w, c in zip(words, counts)]
        for r in pd.concat(list(batches)).sort_values("event_id").itertuples():
            patterns = learn(patterns, set(r.keywords), keep)
        state.update(([sorted(p["keywords"]) for p in patterns], [p["count"] for p in patterns]))
        yield pd.DataFrame({"category": key[0], "patterns": [len(patterns)], "best": [max((p["count"] for p in patterns), default=0)]})

    return feedback.groupBy("category").applyInPandasWithState(step, "category string, patterns int, best int", "words array<array<string>>, counts array<int>", "update", GroupStateTimeout.NoTimeout)


def _part(folder: str, number: int) -> str:
    return f"{folder}/batch={number}"


def _stored(spark: SparkSession, folder: str) -> DataFrame | None:
    """What earlier batches wrote; None before the first."""
    try:
        return spark.read.parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def ingest(pages: DataFrame, distil: Callable[[DataFrame], DataFrame], store: str, postings: str, checkpoint: str, tokens: Callable[[DataFrame], DataFrame], key: str | None = None, gone: str | None = None) -> StreamingQuery:
    """Landed pages -> distilled -> new by content hash -> stored -> postings of the new ones. ``store`` and
    ``postings`` are parquet folders with a part for each batch. With ``key`` (a column of pages and postings) and ``gone``, a folder, each
    batch also writes the keys that an earlier one had: their older postings are dead. A batch that is run again, wherever it
    failed before, looks at the other batches only and writes all its parts anew."""

    def cycle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = distil(batch).withColumn("hash", F.md5("content")).dropDuplicates(["hash"])
        stored = _stored(spark, store)
        earlier = stored.filter(F.col("batch") < number) if stored is not None else None
        if earlier is not None:
            # a page that goes back to an older text is new again, unless that text is what the key has now
            have = earlier.select("hash") if key is None else _latest(earlier, key).select("hash")
            fresh = fresh.hint("merge").join(have, "hash", "left_anti")
        fresh = fresh.persist()
        if not fresh.isEmpty():
            if key is not None and gone is not None:
                old = fresh.select(key).limit(0) if earlier is None else fresh.hint("merge").join(earlier.select(key).distinct(), key, "left_semi").select(key)
                old.distinct().write.mode("overwrite").parquet(_part(gone, number))
            tokens(fresh).write.mode("overwrite").parquet(_part(postings, number))
            fresh.write.mode("overwrite").parquet(_part(store, number))
        fresh.unpersist()

    return pages.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _latest(store: DataFrame, key: str) -> DataFrame:
    last = store.groupBy(key).agg(F.max("batch").alias("batch"))
    return store.hint("merge").join(last, [key, "batch"], "left_semi")


def current(postings: DataFrame, store: DataFrame, key: str = "url") -> DataFrame:
    """The postings of each key's last stored version: those of a page that changed since are left out.
    ``postings`` and ``store`` are what ingest wrote, with its column ``batch``; a row of either holds the key."""
    last = store.groupBy(key).agg(F.max("batch").alias("batch"))
    return postings.hint("merge").join(last, [key, "batch"], "left_semi")


def compact(spark: SparkSession, postings: str, gone: str, key: str = "url") -> int:
    """Takes dead postings off the disk; the number of batches whose part was touched. Parts that hold
    dead postings are written without them to a table of their own, and its parts replace the old ones in one commit; parts of which nothing is left are removed, and
    then the notes of ``gone`` that are served. Run again after a failure anywhere, it ends with the same postings."""
    dead, held = _stored(spark, gone), _stored(spark, postings)
    if dead is None or held is None:
        return 0
    last = written(dead.groupBy(key).agg(F.max("batch").alias("since")), "compaction-dead")
    stale = held.hint("merge").join(last, key).filter(F.col("batch") < F.col("since"))
    touched = [r.batch for r in stale.select("batch").distinct().collect()]  # batches, not keys
    if touched:
        live = held.filter(F.col("batch").isin(touched)).hint("merge").join(last, key, "left").filter(F.col("since").isNull() | (F.col("batch") >= F.col("since")))
        live = written(live.select(held.columns), "compaction-live")
        live.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(postings)
        kept = {r.batch for r in live.select("batch").distinct().collect()}
        for number in touched:
            if number not in kept:
                remove(spark, _part(postings, number))
    for r in dead.select("batch").distinct().collect():
        remove(spark, _part(gone, r.batch))
    return len(touched)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def handled(requests: DataFrame, handlers: Handlers, sink: str, checkpoint: str) -> StreamingQuery:
    """Requests with a column ``handler`` run through their handlers, batch by batch, into parquet. A batch that
    is run again overwrites its own part."""

    def answer(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        handlers.execute(kept).write.mode("overwrite").parquet(f"{sink}/batch={number}")
        kept.unpersist()

    return requests.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_end(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """A finite stream into memory, for tests and small results."""
    q: Any = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
