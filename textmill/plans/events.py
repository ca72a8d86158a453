"""Queries of metrics, memory, sessions and routing over events and conversations."""

from __future__ import annotations

from pyspark.sql.window import Window as W

from ..functions import rules, tokens
from ..operators import metrics as M
from ..operators import search as S
from ..operators import windows as V
from ..operators.spread import carried
from ._base import Catalog, F, read, sql_any, sql_first

C = Catalog()


def events(spark, d):
    return read(spark, d, "events")


STATS = "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, count(*) AS n, round(min(value), 2) AS low, round(max(value), 2) AS high, round(avg(value), 2) AS mean, round(sum((value < 50)::INT) * 100 / count(*), 2) AS success_rate, " + "round(median(value), 2) AS p50, " + ", ".join(f"round(max(CASE WHEN r = least(floor(n * {p} / 100), n - 1) THEN value END), 2) AS p{p}" for p in (95, 99)) + " FROM r GROUP BY event_type"


@C("agg10_agg12_operation_stats", STATS)
def agg10(spark, d):
    return M.operation_stats(events(spark, d), "event_type", "value", F.col("value") < 50)


@C("agg11_counters", "SELECT event_type, round(sum(value), 4) AS total, arg_max(value, (ts, event_id)) AS last FROM events GROUP BY event_type")
def agg11(spark, d):
    e = events(spark, d)
    return M.counters(e, "event_type", "value").join(M.gauges(e, "event_type", "value", F.struct("ts", "event_id")), "event_type")


@C("agg13_running_mean", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 9) AS mean_so_far FROM events")
def agg13(spark, d):
    return M.running_mean(events(spark, d), "user_id", [F.col("ts"), F.col("event_id")], "value").select("event_id", "mean_so_far")


@C("agg7_feedback_stats", "SELECT user_id, count(*) FILTER (event_type = 'purchase') AS accepted, count(*) FILTER (event_type = 'error') AS rejected, round(CASE WHEN count(*) FILTER (event_type IN ('purchase', 'error')) > 0 THEN count(*) FILTER (event_type = 'purchase') * 100 / count(*) FILTER (event_type IN ('purchase', 'error')) ELSE 0 END, 4) AS success_rate FROM events GROUP BY user_id")
def agg7(spark, d):
    return M.success(events(spark, d), ["user_id"], F.col("event_type") == "purchase", F.col("event_type") == "error")


@C("agg8_features", r"SELECT conv_id, turn, length(text)::INT AS query_length, len(string_split(text, chr(10)))::INT AS code_lines, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), 'the|for|and|der|les'))), ',') AS keywords FROM conversations")
def agg8(spark, d):
    words = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("the|for|and|der|les"), 0))), ",")
    return read(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("query_length"), F.size(F.split("text", "\n", -1)).alias("code_lines"), words.alias("keywords"))


@C("agg24_flow", "SELECT conv_id, count(*) AS turns, CASE WHEN count(*) > 5 THEN 'deep dive' ELSE 'stable' END AS flow FROM conversations GROUP BY conv_id")
def agg24(spark, d):
    n = F.count("*")
    return read(spark, d, "conversations").groupBy("conv_id").agg(n.alias("turns"), F.when(n > 5, "deep dive").otherwise("stable").alias("flow"))


@C("agg26_security_report", "SELECT lang, count(*) AS documents, sum(length(text))::BIGINT AS chars, bool_or(contains(lower(text), 'password')) AS holds_passwords FROM documents GROUP BY lang")
def agg26(spark, d):
    return read(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("chars"), F.bool_or(F.lower("text").contains("password")).alias("holds_passwords"))


@C("win7_win8_last_turns", "SELECT conv_id, turn, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank FROM conversations) WHERE rank <= 3")
def win7(spark, d):
    return V.last_n(read(spark, d, "conversations"), ["conv_id"], [F.desc("turn")], 3).select("conv_id", "turn", "rank")


@C("str10_history_cap", "SELECT user_id, count(*) AS kept, min(event_id) AS oldest FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 50 GROUP BY user_id")
def str10(spark, d):
    return V.last_n(events(spark, d), ["user_id"], [F.desc("ts"), F.desc("event_id")], 50).groupBy("user_id").agg(F.count("*").alias("kept"), F.min("event_id").alias("oldest"))


@C("win15_eviction", "WITH u AS (SELECT user_id, event_type, count(*) AS hits, max(ts) AS last FROM events GROUP BY ALL), x AS (SELECT *, sum(hits) OVER (PARTITION BY event_type ORDER BY hits DESC, last DESC, user_id) AS s FROM u) SELECT event_type, user_id, hits FROM x WHERE s <= 500")
def win15(spark, d):
    used = events(spark, d).groupBy("user_id", "event_type").agg(F.count("*").alias("hits"), F.max("ts").alias("last"))
    return V.within_budget(used, ["event_type"], [F.desc("hits"), F.desc("last"), F.col("user_id")], F.col("hits"), 500, least=1).select("event_type", "user_id", "hits")


@C("win16_similar_fix", "SELECT event_id, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS similar FROM events")
def win16(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-10, -1)
    return events(spark, d).select("event_id", F.last(F.when(F.col("event_type") == "error", F.col("event_id")), True).over(w).alias("similar"))


@C("flt13_session_rows", "SELECT user_id, event_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, ts DESC, event_id) AS rank FROM events WHERE value >= 20) WHERE rank <= 5")
def flt13(spark, d):
    return V.last_n(events(spark, d).filter("value >= 20"), ["user_id"], [F.desc("value"), F.desc("ts"), F.col("event_id")], 5).select("user_id", "event_id", "rank")


@C("snk7_updated", "WITH c AS (SELECT user_id, max(value) AS v FROM events WHERE event_type = 'view' GROUP BY user_id) SELECT event_id, coalesce(c.v, e.value) AS value FROM events e LEFT JOIN c ON e.user_id = c.user_id AND e.event_type = 'error'")
def snk7(spark, d):
    """Relevance update: entries joined with a frame of changes."""
    e = events(spark, d)
    change = e.filter("event_type = 'view'").groupBy("user_id").agg(F.max("value").alias("v")).withColumn("event_type", F.lit("error"))
    return e.join(change, ["user_id", "event_type"], "left").select("event_id", F.coalesce("v", "value").alias("value"))


@C("snk8_retention", "WITH m AS (SELECT max(ts) AS now FROM events) SELECT event_type, count(*) AS kept FROM events, m WHERE NOT (ts < now - INTERVAL 10 DAY AND value < 30) GROUP BY event_type")
def snk8(spark, d):
    e = events(spark, d)
    now = e.agg(F.max("ts").alias("now"))
    return e.join(F.broadcast(now)).filter(~((F.col("ts") < F.col("now") - F.expr("INTERVAL 10 DAYS")) & (F.col("value") < 30))).groupBy("event_type").agg(F.count("*").alias("kept"))


@C("snk9_capped_append", "SELECT event_id, substring(props, 1, 200) AS task FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 150")
def snk9(spark, d):
    return V.last_n(events(spark, d), ["event_type"], [F.desc("ts"), F.desc("event_id")], 150).select("event_id", F.substring("props", 1, 200).alias("task"))


@C("snk10_upsert", "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def snk10(spark, d):
    return events(spark, d).groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


@C("jn3_prefetch", "WITH t AS (SELECT event_type AS topic, min(event_id) AS ord FROM events GROUP BY 1 UNION ALL SELECT regexp_extract(lower(text), '[a-z]{5,}') AS topic, min(doc_id) + 1000000 FROM documents WHERE regexp_matches(lower(text), '[a-z]{5,}') GROUP BY 1), w AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM conversations), p AS (SELECT word, topic, ord FROM (SELECT DISTINCT word FROM w) JOIN t ON contains(word, topic)) SELECT conv_id, turn, arg_min(topic, ord) AS topic FROM w JOIN p USING (word) GROUP BY ALL")
def jn3(spark, d):
    """The first topic that stands in a word of a turn. Topics are the event types and each document's
    first word of five letters or more; both sides are reduced to distinct words, which meet on trigrams."""
    own = events(spark, d).groupBy(F.col("event_type").alias("topic")).agg(F.min("event_id").alias("ord"))
    topic = F.regexp_extract(F.lower("text"), "[a-z]{5,}", 0)
    more = read(spark, d, "documents").select(topic.alias("topic"), "doc_id").filter("topic != ''").groupBy("topic").agg((F.min("doc_id") + 1000000).alias("ord"))
    topics = own.unionByName(more)
    words = read(spark, d, "conversations").select("conv_id", "turn", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0))).alias("token"))
    pairs = S.containing(words.select("token").distinct(), topics.select(F.col("topic").alias("word")).distinct()).filter(F.contains("token", "word"))
    first = pairs.hint("merge").join(topics.withColumnRenamed("topic", "word"), "word").groupBy("token").agg(F.min(F.struct("ord", "word")).alias("t"))
    return words.hint("merge").join(first, "token").groupBy("conv_id", "turn").agg(F.min("t").alias("t")).select("conv_id", "turn", F.col("t.word").alias("topic"))


@C("jn10_learning_context", r"WITH t AS (SELECT conv_id, turn, role, list_distinct(string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' ')) AS w FROM conversations), q AS (SELECT * FROM t WHERE role = 'user'), e AS (SELECT conv_id, turn, w FROM t WHERE role = 'assistant') SELECT q.conv_id, q.turn, count(*) AS hits, round(max(len(list_intersect(q.w, e.w)) / greatest(len(q.w), 1)), 6) AS best FROM q JOIN e ON q.conv_id = e.conv_id WHERE len(list_intersect(q.w, e.w)) / greatest(len(q.w), 1) > 0.3 GROUP BY ALL")
def jn10(spark, d):
    """Answers of the same conversation that share over 0.3 of a question's words."""
    t = read(spark, d, "conversations").select("conv_id", "turn", "role", F.array_distinct(tokens.blank_split(F.col("text"))).alias("w"))
    q, e = t.filter("role = 'user'"), t.filter("role = 'assistant'").select("conv_id", F.col("w").alias("v"))
    share = F.size(F.array_intersect("w", "v")) / F.greatest(F.size("w"), F.lit(1))
    return q.join(e, "conv_id").withColumn("s", share).filter("s > 0.3").groupBy("conv_id", "turn").agg(F.count("*").alias("hits"), F.round(F.max("s"), 6).alias("best"))


@C("jn14_parents", "WITH s AS (SELECT event_id, user_id, event_type, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS parent FROM events) SELECT p.event_type AS parent_type, c.event_type AS child_type, count(*) AS n FROM s c JOIN s p ON c.parent = p.event_id GROUP BY ALL")
def jn14(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    s = events(spark, d).select("event_id", "event_type", F.lag("event_id").over(w).alias("parent"))
    return s.select(F.col("event_type").alias("child_type"), "parent").join(s.select(F.col("event_id").alias("parent"), F.col("event_type").alias("parent_type")), "parent").groupBy("parent_type", "child_type").agg(F.count("*").alias("n"))


@C("jn15_pairs", "WITH o AS (SELECT event_id, ts, event_type, user_id || ':' || (props::JSON->>'k') AS op FROM events) SELECT s.op, s.event_id AS start_id, e.event_id AS end_id, (epoch_us(e.ts) - epoch_us(s.ts))::BIGINT AS micros FROM o s JOIN o e ON s.op = e.op AND s.event_type = 'view' AND e.event_type = 'purchase' AND epoch_us(e.ts) - epoch_us(s.ts) BETWEEN 0 AND 604800000000")
def jn15(spark, d):
    """A view starts an operation of a user and a number, a purchase within a week ends it."""
    e = operations(events(spark, d).withColumn("ts", F.col("ts").cast("timestamp")))
    return V.paired(e.filter("event_type = 'view'"), e.filter("event_type = 'purchase'"), 7 * 24 * 3600)


def operations(e):
    """Events with the id of the operation they belong to; the time is left as it is, as a stream's carries its watermark."""
    return e.select("event_id", "ts", "event_type", F.concat_ws(":", "user_id", F.get_json_object("props", "$.k")).alias("op"))


@C("str2_cooldown", "WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events), a AS (SELECT user_id, arg_min(event_id, (t, event_id)) AS event_id, min(t) AS t FROM e GROUP BY user_id UNION ALL SELECT user_id, n.event_id, n.t FROM (SELECT a.user_id, min((e.t, e.event_id)) AS m FROM a JOIN e ON e.user_id = a.user_id AND e.t > a.t + 21600000000 GROUP BY a.user_id) x, LATERAL (SELECT x.m[2] AS event_id, x.m[1] AS t) n) SELECT event_id, user_id FROM a")
def str2(spark, d):
    return V.cooled(events(spark, d).select("event_id", "user_id", "ts"), 6 * 3600).select("event_id", "user_id")


@C("str3_items_per_cycle", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY time_bucket(INTERVAL 10 MINUTE, ts) ORDER BY ts, event_id) AS r FROM events) WHERE r <= 3")
def str3(spark, d):
    cycle = F.window(F.col("ts").cast("timestamp"), "10 minutes")
    return V.last_n(events(spark, d).withColumn("cycle", cycle), ["cycle"], [F.col("ts"), F.col("event_id")], 3).select("event_id")


@C("str5_sessions", "WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 300000000 THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, session::BIGINT AS session, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts)))::BIGINT AS micros FROM s GROUP BY ALL")
def str5(spark, d):
    e = events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return V.sessions(e).select("user_id", "session", "n", (F.unix_micros("end_ts") - F.unix_micros("start_ts")).alias("micros"))


@C("str8_bounded_queue", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 100")
def str8(spark, d):
    return V.last_n(events(spark, d).withColumn("day", F.date_trunc("day", "ts")), ["day"], [F.desc("ts"), F.desc("event_id")], 100).select("event_id")


@C("scl1_dates", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY event_id)) > 300000000 AS idle FROM events QUALIFY lag(ts) OVER (ORDER BY event_id) IS NOT NULL")
def scl1(spark, d):
    e = events(spark, d).select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    both = carried(e, [], [F.col("event_id")], {"t0": F.col("ts")}).filter("t0 IS NOT NULL")  # the event before, whatever its id
    return both.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), (F.unix_micros("ts") - F.unix_micros("t0") > 300000000).alias("idle"))


@C("scl2_numbers", "SELECT event_id, round(ln(value + 1), 6) AS l, round(sqrt(value), 6) AS s, greatest(0.0, least(1.0, value / 100))::DOUBLE AS c FROM events")
def scl2(spark, d):
    v = F.col("value")
    return events(spark, d).select("event_id", F.round(F.log(v + 1), 6).alias("l"), F.round(F.sqrt(v), 6).alias("s"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / 100)).alias("c"))


@C("scl5_json", "SELECT event_id, (props::JSON->>'k')::BIGINT AS k, coalesce(props::JSON->>'missing', '') AS missing FROM events")
def scl5(spark, d):
    j = F.from_json("props", "k bigint, missing string")
    return events(spark, d).select("event_id", j["k"].alias("k"), F.coalesce(j["missing"], F.lit("")).alias("missing"))


@C("scl4_maps", "SELECT event_id, coalesce(element_at(map {event_type: value}, 'error')[1], -1.0)::DOUBLE AS e FROM events")
def scl4(spark, d):
    m = F.map_concat(F.create_map(F.lit("other"), F.lit(0.0)), F.create_map("event_type", "value"))
    return events(spark, d).select("event_id", F.coalesce(F.try_element_at(m, F.lit("error")), F.lit(-1.0)).alias("e"))


@C("src6_records", "SELECT event_id, event_type || '_' || user_id AS key, 'learning' AS intent, 2 AS priority FROM events WHERE event_type = 'purchase'")
def src6(spark, d):
    """Learning entries: key type_n, intent and priority."""
    return events(spark, d).filter("event_type = 'purchase'").select("event_id", F.concat_ws("_", "event_type", "user_id").alias("key"), F.lit("learning").alias("intent"), F.lit(2).alias("priority"))


@C("src7_log_lines", "SELECT event_type AS level, count(*) AS n, max(ts)::TIMESTAMP AS last FROM (SELECT upper(event_type) AS event_type, date_trunc('second', ts) AS ts FROM events) GROUP BY 1")
def src7(spark, d):
    """Events written as log lines and parsed again."""
    from ..sources.readers import parsed_log

    line = F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("] ["), F.upper("event_type"), F.lit("] "), "props")
    return parsed_log(events(spark, d).select(line.alias("line")), F.col("line")).groupBy("level").agg(F.count("*").alias("n"), F.max("ts").cast("timestamp_ntz").alias("last"))


_KINDS = sql_first("text", rules.QUESTIONS, "general")


@C("lifecycle_query_plan", f"WITH q AS (SELECT conv_id, turn, {sql_any('text', rules.DOMAIN)} AS related, {_KINDS} AS kind, length(text) AS n FROM conversations WHERE role = 'user') SELECT conv_id, turn, related, kind, sum(n) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS spent FROM q QUALIFY spent <= 2000")
def lifecycle(spark, d):
    """A question's way through domain test, question type and context budget."""
    q = read(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", tokens.any_of(F.col("text"), rules.DOMAIN).alias("related"), rules.first_match(F.col("text"), rules.QUESTIONS, "general").alias("kind"), F.length("text").alias("n"))
    return V.within_budget(q, ["conv_id"], [F.col("turn")], F.col("n"), 2000).select("conv_id", "turn", "related", "kind", F.col("spent").cast("long"))


@C("agg9_str7_patterns")
def agg9(spark, d):
    """Patterns learned from the words of user turns, by conversation."""
    from ..operators.feedback import learned_patterns

    words = F.array_distinct(F.filter(tokens.blank_split(F.col("text")), lambda w: F.length(w) > 3))
    turns = read(spark, d, "conversations").filter("role = 'user'")
    return learned_patterns(turns.select(F.concat_ws("_", F.lit("conv"), F.col("conv_id")).alias("category"), (F.col("conv_id") * 1000 + F.col("turn")).alias("event_id"), words.alias("keywords")))


@C("udf1_handlers", f"SELECT conv_id, turn, CASE WHEN {sql_any('text', rules.DOMAIN_ROUTE)} THEN upper(substring(text, 1, 5)) ELSE lower(substring(text, 1, 5)) END AS answer FROM conversations")
def udf1(spark, d):
    from ..operators.feedback import Handlers

    h = Handlers("general")
    h.register("expert", lambda df: df.select("conv_id", "turn", F.upper(F.substring("text", 1, 5)).alias("answer")))
    h.register("general", lambda df: df.select("conv_id", "turn", F.lower(F.substring("text", 1, 5)).alias("answer")))
    to = F.when(tokens.any_of(F.col("text"), rules.DOMAIN_ROUTE), "expert").otherwise("other")
    return h.execute(read(spark, d, "conversations").withColumn("handler", to))


@C("cls5_trained_intent")
def cls5(spark, d):
    """A classifier of turns by role-free text: trained on documents' languages, used on conversations."""
    from ..operators.feedback import intent_model

    learned = intent_model(read(spark, d, "documents").select("text", F.col("lang").alias("intent")), 500)
    return learned.transform(read(spark, d, "conversations")).select("conv_id", "turn", "predicted")


@C("cls5_intents_of_turns")
def cls5_turns(spark, d):
    """Turns' intents from a model that learned from the answered turns, logged with the rules' intents; the rules where it isn't sure."""
    from ..operators.feedback import intent_model, intents

    turns = read(spark, d, "conversations")
    logged = turns.filter("role = 'user'").select("text", rules.intent(F.col("text"))["intent"].alias("intent"))
    return intents(intent_model(logged, 500), turns).select("conv_id", "turn", "intent", F.round("confidence", 4).alias("confidence"), "learned")
