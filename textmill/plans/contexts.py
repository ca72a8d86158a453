"""Queries that build context for questions. The benchmark's items ask, and each document is a file named by its first long word."""

from __future__ import annotations

from ..operators import context as X
from ._base import Catalog, F, read

C = Catalog()

PROJECT = r"pj AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) > 3) AS w, text AS content, source FROM documents WHERE text IS NOT NULL), fl AS (SELECT doc_id, source || '/' || doc_id || '/' || coalesce(w[1], 'x') || '.gd' AS path, coalesce(w[1], 'x') AS name, list_distinct(list_slice(w, 2, 3)) AS tags, content, len(string_split(content, chr(10))) % 4 AS issues, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS scenes FROM pj), qs AS (SELECT item_id AS qid, lower(text) AS lq, list_filter(string_split_regex(lower(text), '\s+'), lambda x: length(x) > 3) AS ws FROM benchmark)"
GAIN = "(CASE WHEN contains(lq, name) OR len(list_filter(ws, lambda x: contains(name, x))) > 0 THEN 2 ELSE 0 END + len(list_filter(tags, lambda t: contains(lq, t))))"


def project(spark, d):
    w = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0), lambda x: F.length(x) > 3)
    rows = read(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "source", w.alias("w"), F.col("text").alias("content"))
    path = F.concat("source", F.lit("/"), "doc_id", F.lit("/"), F.coalesce(F.get("w", F.lit(0)), F.lit("x")), F.lit(".gd"))
    return rows.select("doc_id", path.alias("path"), F.slice("w", 2, 2).alias("tags"), "content")


def questions(spark, d):
    return read(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


def tags(files):
    return files.select("path", F.explode("tags").alias("tag"))


@C("flt14_question_files", f"WITH {PROJECT}, s AS (SELECT qid, path, {GAIN}::DOUBLE AS score FROM qs, fl), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, path)::INT AS rank FROM s WHERE score > 0) SELECT qid, path, score, rank FROM r WHERE rank <= 10")
def flt14(spark, d):
    """The files of each question by name and tags."""
    f = project(spark, d)
    none = spark.createDataFrame([], "scene string, script string")
    return X.relevant_files(questions(spark, d), f, tags(f), none)


_DEBUG = " OR ".join(f"contains(lq, '{w}')" for w in X.DEBUG_WORDS)


@C("top9_question_context", f"WITH {PROJECT}, s AS (SELECT qid, path, content, {GAIN} + scenes * 0.5 + CASE WHEN {_DEBUG} THEN issues * 0.5 ELSE 0 END AS score FROM qs, fl WHERE content <> ''), r AS (SELECT *, row_number() OVER w AS rank, sum(length(content)) OVER (w ROWS UNBOUNDED PRECEDING) AS spent FROM s WINDOW w AS (PARTITION BY qid ORDER BY score DESC, path)), p AS (SELECT qid, rank, '### ' || path || chr(10) || '```gdscript' || chr(10) || CASE WHEN spent > 8000 THEN substring(content, 1, 8000) || chr(10) || '# [TRUNCATED]' ELSE content END || chr(10) || '```' AS part FROM r WHERE spent <= 8000 OR rank = 1) SELECT qid, count(*) AS files, md5(string_agg(part, chr(10) || chr(10) ORDER BY rank)) AS h FROM p GROUP BY qid")
def top9(spark, d):
    """Context of each question: files by name, tags, issues and scenes, up to 8,000 characters."""
    f = project(spark, d)
    issues = f.select("path", (F.size(F.split("content", "\n", -1)) % 4).alias("n"))
    use = lambda k: f.filter(F.col("doc_id") % k == 0).select(F.concat(F.lit(f"scene{k}/"), "doc_id").alias("scene"), F.col("path").alias("script"))
    out = X.selected_context(questions(spark, d), f, tags(f), issues, use(3).unionByName(use(5)))
    return out.select("qid", "files", F.md5("context").alias("h"))


NAMED = r"nq AS (SELECT item_id AS qid, CASE WHEN item_id % 2 = 0 THEN 'fix ' || (SELECT min(name) FROM fl WHERE doc_id = item_id) || '.gd now' ELSE text END AS text FROM benchmark), q2 AS (SELECT qid, text, lower(text) AS lq, list_filter(string_split_regex(lower(text), '\s+'), lambda x: length(x) > 3) AS ws, lower(regexp_extract(text, '\b([\w_-]+\.gd)\b', 1)) AS asked FROM nq)"


@C("top13_light_context", rf"WITH {PROJECT}, {NAMED}, h AS (SELECT qid, min(path) AS target FROM q2 JOIN fl ON name || '.gd' = asked GROUP BY qid), x AS (SELECT qid, target, 0 AS pos, target AS path FROM h UNION ALL SELECT qid, target, 1, min(b.path) FROM h JOIN fl a ON a.path = target JOIN fl b ON b.doc_id = a.doc_id + 1 GROUP BY ALL), s AS (SELECT qid, path, {GAIN} AS score FROM q2, fl WHERE qid NOT IN (SELECT qid FROM h)), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, path) AS rank FROM s WHERE score > 0), c AS (SELECT qid, pos, path FROM x UNION ALL SELECT qid, 0, path FROM r WHERE rank = 1), p AS (SELECT qid, pos, '[' || path || '] ' || substring(replace(substring(content, 1, 200), chr(10), ' '), 1, 150) AS part FROM c JOIN fl USING (path) WHERE content <> ''), k AS (SELECT *, sum(length(part) + 2) OVER (PARTITION BY qid ORDER BY pos) - 2 AS run FROM p) SELECT qid, substring(string_agg(part, chr(10) || chr(10) ORDER BY pos), 1, 300) AS context FROM k WHERE run <= 300 GROUP BY qid")
def top13(spark, d):
    """Every second question names a file; a file depends on that of the next document."""
    f = project(spark, d)
    name = F.regexp_extract("path", "[^/]+$", 0)
    asks = questions(spark, d).hint("merge").join(f.groupBy(F.col("doc_id").alias("qid")).agg(F.min(name).alias("name")), "qid", "left")
    asks = asks.select("qid", F.when(F.col("qid") % 2 == 0, F.concat(F.lit("fix "), "name", F.lit(" now"))).otherwise(F.col("text")).alias("text"))
    own = f.select(F.col("path").alias("target"), F.lit(0).alias("pos"), "path")
    following = f.select((F.col("doc_id") - 1).alias("doc_id"), F.col("path").alias("next"))
    deps = f.hint("merge").join(following, "doc_id").groupBy(F.col("path").alias("target")).agg(F.min("next").alias("path")).select("target", F.lit(1).alias("pos"), "path")
    return X.light_context(asks, f, tags(f), own.unionByName(deps))


@C("jn10_last_entries", r"WITH t AS (SELECT conv_id * 1000 + turn AS event_id, role, text, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS w FROM conversations), e AS (SELECT * FROM t ORDER BY event_id DESC LIMIT 100), q AS (SELECT event_id AS qid, w FROM t WHERE role = 'user'), s AS (SELECT qid, event_id, text, len(list_intersect(q.w, e.w)) / len(q.w) AS share FROM q, e WHERE role = 'assistant'), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY share DESC, event_id)::INT AS rank FROM s WHERE share > 0.3) SELECT qid, rank, substring(text, 1, 300) AS example, round(share * 10, 6) AS weight FROM r WHERE rank <= 5")
def jn10(spark, d):
    """Each question's examples among the last hundred turns, of which the assistant's are accepted."""
    t = read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("event_id"), "role", "text")
    asks = t.filter("role = 'user'").select(F.col("event_id").alias("qid"), F.lit("a").alias("category"), F.lit("b").alias("general"), "text")
    history = t.select("event_id", F.col("text").alias("query"), F.col("text").alias("fix"), (F.col("role") == "assistant").alias("accepted"))
    none = spark.createDataFrame([], "category string, keywords string, success_count long")
    return X.learning_context(asks, history, none).select("qid", "rank", "example", "weight")


