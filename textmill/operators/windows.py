"""Budgets, caps, first occurrences and sessions as window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .scratch import written
from .spread import carried, running


def within_budget(df: DataFrame, by: list[str], order: list[Column], cost: Column, budget: float, least: float | None = None, free: bool = False) -> DataFrame:
    """In rank order, the rows up to the first one that would exceed the budget: as costs aren't
    negative, those whose running sum stays within it. Where no row costs less than ``least``, only the
    first budget / least of each group can fit: they are ranked first, which Spark limits in each task.
    With ``free``, rows that cost less (or null) may occur; they are set apart from the ranking."""
    if least:
        full = last_n(df.filter(cost >= least) if free else df, by, order, int(budget // least)).drop("rank")
        df = full.unionByName(df.filter(~F.coalesce(cost >= least, F.lit(False)))) if free else full
        if not free:  # few rows a group are left
            run = F.sum(cost).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
            return df.withColumn("spent", run).filter(F.col("spent") <= budget)
    return running(df, by, order, {"spent": cost}).filter(F.col("spent") <= budget)


def filled(df: DataFrame, by: list[str], order: list[Column], text: str, budget: int, mark: str = "") -> DataFrame:
    """As within_budget, but the row that crosses the budget is cut to fit and gets ``mark``, and no row comes after it."""
    rows = running(df, by, order, {"before": F.length(text)}, before=True).filter(F.col("before") < budget)
    room = (F.lit(budget) - F.col("before")).cast("int")
    cut = F.substring(F.col(text), F.lit(1), room)
    return rows.withColumn(text, F.when(F.length(text) > room, F.concat(cut, F.lit(mark))).otherwise(cut))


def project_stats(files: DataFrame) -> DataFrame:
    """files(path, issues, improvements, loaded) -> one row: scripts, scenes, total_files, total_issues, total_improvements, loaded_files.
    Findings of scripts count."""
    script = F.col("path").endswith(".gd")
    found = lambda c: F.coalesce(F.sum(F.when(script, F.size(F.coalesce(c, F.array().cast("array<string>"))))), F.lit(0)).cast("long")
    return files.agg(
        F.count_if(script).alias("scripts"), F.count_if(F.col("path").endswith(".tscn")).alias("scenes"), F.count("*").alias("total_files"),
        found("issues").alias("total_issues"), found("improvements").alias("total_improvements"), F.count_if("loaded").alias("loaded_files"),
    )


def last_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= n)


def first_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text with every line kept at its first place only."""
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "line"))
    first = lines.groupBy(id_col, "line").agg(F.min("pos").alias("pos"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x.line), "\n")
    return first.groupBy(id_col).agg(F.count("*").alias("n_lines"), joined.alias("text"))


def line_chunks(docs: DataFrame, size: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks of ``size`` lines, blank ones left out: chunk, first and last line, content."""
    lines = F.split(text_col, "\n", -1)
    at = F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / size).cast("int"))
    parts = docs.select(id_col, lines.alias("ls"), F.explode(at).alias("chunk"))
    content = F.array_join(F.slice("ls", F.col("chunk") * size + 1, F.lit(size)), "\n")
    rows = parts.select(id_col, "chunk", (F.col("chunk") * size + 1).alias("start_line"), F.least(F.size("ls"), (F.col("chunk") + 1) * size).alias("end_line"), content.alias("content"))
    return rows.filter(F.trim(F.regexp_replace("content", r"\s", "")) != "")


def sessions(events: DataFrame, gap_seconds: int = 300, by: str = "user_id", ts: str = "ts") -> DataFrame:
    """Sessions that end after ``gap_seconds`` without an event: start, end, count. A key's events are spread over all tasks: the
    time before and the number of the session are prefix scans."""
    order = [F.col(ts)]
    timed = carried(events, [by], order, {"_before": F.unix_micros(F.col(ts))})
    new = F.coalesce((F.unix_micros(F.col(ts)) - F.col("_before") >= gap_seconds * 1_000_000).cast("int"), F.lit(1))
    numbered = running(timed, [by], order, {"session": new})
    return numbered.groupBy(by, "session").agg(F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count("*").alias("n"))


def cooled(events: DataFrame, seconds: int, by: str = "user_id", ts: str = "ts", id_col: str = "event_id") -> DataFrame:
    """Rows accepted if more than ``seconds`` passed since the key's last accepted one, the first of a key in any case; of
    rows of one time the smallest id comes first, rows without a time come last.

    Each row's next acceptable one is the first that is later by more than ``seconds``, found by a scan over rows and the ends of
    their cooldowns in one order. The accepted rows are the chain of these links from the first row: by pointer
    doubling, each round adds as many links as it has and doubles their reach, so a key's history may be long and spread over all tasks."""
    rows = written(events.withColumn("_row", F.monotonically_increasing_id()), "cooldown-rows")
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    timed = rows.filter(F.col(ts).isNotNull()).select(by, at.alias("t"), F.col(id_col).alias("id"), "_row")
    both = timed.withColumn("end", F.lit(0)).unionByName(timed.withColumn("t", F.col("t") + seconds * 1_000_000).withColumn("end", F.lit(1)))
    # from the latest back: what came last before an end is the first row after it in time
    scanned = carried(both, [by], [F.desc("t"), F.desc("end"), F.desc("id"), F.desc("_row")], {"next": F.when(F.col("end") == 0, F.col("_row"))})
    jump = written(scanned.filter("end = 1 AND next IS NOT NULL").select("_row", "next"), "cooldown-links")
    first = F.min(F.struct(F.col(ts).isNull().alias("none"), F.col(ts).alias("t"), F.col(id_col).alias("id"), F.col("_row").alias("row")))
    taken = written(rows.groupBy(by).agg(first.alias("f")).select(F.col("f.row").alias("_row")), "cooldown-taken")
    while True:
        more = written(taken.hint("merge").join(jump, "_row").select(F.col("next").alias("_row")), "cooldown-more")
        if more.isEmpty():
            break
        taken = written(taken.unionByName(more), "cooldown-taken")
        ahead = jump.select(F.col("_row").alias("next"), F.col("next").alias("after"))
        jump = written(jump.hint("merge").join(ahead, "next").select("_row", F.col("after").alias("next")), "cooldown-links")
    return rows.hint("merge").join(taken, "_row", "left_semi").drop("_row")


def paired(starts: DataFrame, ends: DataFrame, within_seconds: int, by: str = "op") -> DataFrame:
    """Starts and ends (``by``, event_id, ts) of one operation, the end at most ``within_seconds`` after the start."""
    s = starts.select(F.col(by), F.col("event_id").alias("start_id"), F.unix_micros("ts").alias("t0"))
    e = ends.select(F.col(by), F.col("event_id").alias("end_id"), F.unix_micros("ts").alias("t1"))
    met = s.hint("merge").join(e, by).withColumn("micros", F.col("t1") - F.col("t0"))
    return met.filter((F.col("micros") >= 0) & (F.col("micros") <= within_seconds * 1_000_000)).select(by, "start_id", "end_id", "micros")
