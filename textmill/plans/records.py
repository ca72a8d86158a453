"""Queries of files' metadata, reports and records; paths, scripts and project files are made from the documents."""

from __future__ import annotations

from ..functions import files as K
from ..functions import guards
from ..operators import windows as V
from . import searches
from ._base import Catalog, F, quoted, read

C = Catalog()


def documents(spark, d):
    return read(spark, d, "documents")


_NAMES = [*K.TOPICS, "Notes_on_GODOT", "plain"]
_NAME = "list_extract([" + ", ".join(map(quoted, _NAMES)) + f"], (doc_id % {len(_NAMES)} + 1)::INT) || '_' || doc_id"


def _chain(table: dict, value, default: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower(stem), '{k}') THEN {value(v)}" for k, v in table.items()) + f" ELSE {default} END"


@C("src4_knowledge_files", f"WITH k AS (SELECT doc_id, {_NAME} AS stem FROM documents) SELECT doc_id, {_chain(K.MODES, quoted, quoted('mixed'))} AS mode, {_chain(K.TOPICS, lambda t: quoted(','.join(t)), quoted(''))} AS topics FROM k")
def src4(spark, d):
    """Mode and topics of files by their names."""
    stem = F.concat(F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("doc_id") % len(_NAMES) + 1).cast("int")), F.lit("_"), "doc_id")
    return documents(spark, d).select("doc_id", stem.alias("stem")).select("doc_id", K.mode_of(F.col("stem")).alias("mode"), F.array_join(K.topics_of(F.col("stem")), ",").alias("topics"))


_ASCII = r"regexp_replace(text, '[^\x00-\x7F]', '?', 'g')"
_INJECTED = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, {quoted(p)}) THEN {quoted(p)} END" for p in guards.INJECTION) + "], lambda x: x IS NOT NULL)"


def _masked(text: str) -> str:
    for kind, p in guards.SECRETS.items():
        text = f"regexp_replace({text}, {quoted(p)}, '[REDACTED_{kind}]', 'g')"
    return text


@C("grd5_input_records", f"WITH a AS (SELECT doc_id, {_ASCII} AS t FROM documents WHERE text IS NOT NULL), m AS (SELECT *, {_INJECTED} AS m, {_masked('t')} AS k FROM a) SELECT doc_id, len(m) = 0 AS is_safe, md5(CASE WHEN len(m) > 0 THEN '' ELSE k END) AS processed, len(m) > 0 AS injection_detected, CASE WHEN len(m) > 0 THEN least(1.0, len(m) / 2.0) ELSE 0.0 END::DOUBLE AS injection_confidence, len(m)::INT AS blocked_patterns, len(m) = 0 AND k <> t AS masked, length(t)::INT AS original_length FROM m")
def grd5(spark, d):
    """What the input pipeline makes of each text: whether it is safe, the text blocked or masked, and the metadata."""
    plain = documents(spark, d).filter("text IS NOT NULL").select("doc_id", F.regexp_replace("text", r"[^\x00-\x7F]", "?").alias("t"))
    out = plain.select("doc_id", guards.processed(F.col("t")).alias("p")).select("doc_id", "p.is_safe", "p.processed", "p.metadata.*")
    return out.withColumns({"processed": F.md5("processed"), "blocked_patterns": F.size("blocked_patterns")})


@C("agg26_report", f"WITH a AS (SELECT source, lang, text, {_ASCII} AS t FROM documents) SELECT count(*) AS entries, count(DISTINCT source) AS sources, coalesce(sum(octet_length(encode(text))), 0)::BIGINT AS bytes, count(*) FILTER ({_masked('t')} <> t) AS holding_secrets, true AS security_active, true AS injection_protection, true AS sandbox_enabled, count(*) FILTER ({_masked('t')} <> t) > 0 AS secrets_masked FROM a")
def agg26(spark, d):
    """The storage's counts and the state of its guards."""
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", "?")
    secret = F.count_if(guards.masked(plain) != plain)
    counts = documents(spark, d).agg(F.count("*").alias("entries"), F.countDistinct("source").alias("sources"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long").alias("bytes"), secret.alias("holding_secrets"))
    return guards.report(counts, F.col("holding_secrets"))


_KEYWORDS = rf"(?:^|[^\p{{L}}\p{{N}}_])({K.KEYWORDS})(?:$|[^\p{{L}}\p{{N}}_])"


@C("agg8_entry_features", rf"WITH e AS (SELECT conv_id, turn, role, text, list_distinct(list_filter(string_split_regex(lower(text || ' ' || substring(text, 1, 40)), '[^\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '{K.KEYWORDS}'))) AS k FROM conversations) SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'unknown' WHEN turn % 3 = 1 THEN '.gd' ELSE '' END AS file_extension, CASE WHEN turn % 2 = 0 THEN 'general' ELSE role END AS error_type, length(text)::INT AS query_length, len(string_split(substring(text, 1, 40), chr(10)))::INT AS code_lines, len(string_split(text, chr(10)))::INT AS fix_lines, array_to_string(list_sort(k), ',') AS keywords FROM e")
def agg8(spark, d):
    """Features of each turn as a feedback entry: its text asks, its beginning is the code, its text the fix."""
    path = F.when(F.col("turn") % 3 == 0, "").when(F.col("turn") % 3 == 1, "res/a.b/x.gd").otherwise("res/a.b/Makefile")
    f = K.features(F.col("text"), F.substring("text", 1, 40), F.col("text"), path, F.when(F.col("turn") % 2 == 0, "").otherwise(F.col("role")))
    return read(spark, d, "conversations").select("conv_id", "turn", f.alias("f")).select("conv_id", "turn", "f.*").withColumn("keywords", F.array_join("keywords", ","))


@C("agg17_project_stats", r"WITH f AS (SELECT source || '/' || doc_id || list_extract(['.gd', '.tscn', '.md'], (doc_id % 3 + 1)::INT) AS path, string_split(coalesce(text, ''), chr(10)) AS ls, doc_id % 4 > 0 AS loaded FROM documents) SELECT count(*) FILTER (path LIKE '%.gd') AS scripts, count(*) FILTER (path LIKE '%.tscn') AS scenes, count(*) AS total_files, coalesce(sum(len(list_filter(ls, lambda x: contains(lower(x), 'the')))) FILTER (path LIKE '%.gd'), 0)::BIGINT AS total_issues, coalesce(sum(len(list_filter(ls, lambda x: contains(lower(x), 'und')))) FILTER (path LIKE '%.gd'), 0)::BIGINT AS total_improvements, count(*) FILTER (loaded) AS loaded_files FROM f")
def agg17(spark, d):
    """A project's map: files by kind, what its scripts' findings come to, how many files are loaded."""
    path = F.concat("source", F.lit("/"), "doc_id", F.element_at(F.array(F.lit(".gd"), F.lit(".tscn"), F.lit(".md")), (F.col("doc_id") % 3 + 1).cast("int")))
    with_ = lambda w: F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.contains(F.lower(x), F.lit(w)))
    return V.project_stats(documents(spark, d).select(path.alias("path"), with_("the").alias("issues"), with_("und").alias("improvements"), (F.col("doc_id") % 4 > 0).alias("loaded")))


@C("lnt13_autoloads", r"WITH p AS (SELECT doc_id, regexp_extract(lower(text), '[a-z]+') AS w, doc_id % 4 AS k FROM documents WHERE text IS NOT NULL) SELECT doc_id, k IN (0, 1) AND w <> '' AS registered, CASE WHEN k = 2 THEN w ELSE '' END AS autoloads FROM p WHERE w <> ''")
def lnt13(spark, d):
    """Whether each document's first word is an autoload of a project file: under the heading, by a path, by name only, not at all."""
    w, k = F.col("w"), F.col("doc_id") % 4
    rows = documents(spark, d).filter("text IS NOT NULL").select("doc_id", F.regexp_extract(F.lower("text"), "[a-z]+", 0).alias("w")).filter("w <> ''")
    other = F.concat(F.lit('\nx'), w, F.lit('x="res://y.gd"'))
    project = F.when(k == 0, F.concat(F.lit("[autoload]\n\n"), w, F.lit('="*res://a.gd"'))).when(k == 1, F.concat(F.lit("[autoload]\nother=1\n"), w, F.lit(' = "res://a.gd"'))).when(k == 2, F.concat(F.lit('[x]\nresource/name="'), w, F.lit('"'))).otherwise(F.concat(F.lit("[autoload]"), other))
    return rows.withColumn("p", project).select("doc_id", K.registered(w, F.col("p")).alias("registered"), F.array_join(K.autoloads(F.col("p")), ",").alias("autoloads"))


@C("lnt14_bindings", "SELECT doc_id, doc_id % 2 = 0 AND doc_id % 3 > 0 AND doc_id % 5 > 0 AS faulty FROM documents")
def lnt14(spark, d):
    """Scripts with and without a uid against scenes that hold a script or none, with a uid or without."""
    script = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("uid://s"), "doc_id")).otherwise(F.concat(F.lit("res://"), "doc_id"))
    scene = F.concat(F.lit("[gd_scene]\n"), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit('script = ExtResource("'), "doc_id", F.lit('")\n'))).otherwise(""), F.when(F.col("doc_id") % 5 == 0, "uid://x").otherwise(""))
    return documents(spark, d).select("doc_id", (F.size(K.binding_issues(script, scene)) > 0).alias("faulty"))


@C("lnt19_first_lines", "WITH w AS (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN 'the' ELSE coalesce(source, '') END AS target FROM documents) SELECT doc_id, coalesce(nullif(list_position(list_transform(string_split(text, chr(10)), lambda x: contains(x, target)), true), 0), -1)::INT AS line_no FROM w")
def lnt19(spark, d):
    target = F.when(F.col("doc_id") % 2 == 0, "the").otherwise(F.coalesce("source", F.lit("")))
    return documents(spark, d).select("doc_id", K.line_of(F.col("text"), target).alias("line_no"))


_TERMS = "[" + ", ".join(map(quoted, K.CODE_TERMS)) + "]"


@C("top8_chunk_relevance", rf"WITH q AS (SELECT doc_id, list_extract(['optimize ', 'fix ', ''], (doc_id % 3 + 1)::INT) || string_split(text, chr(10))[1] AS q, lower(text) || CASE WHEN doc_id % 5 = 0 THEN ' error' ELSE '' END AS t, doc_id % 2 = 0 AS f FROM documents WHERE text IS NOT NULL), w AS (SELECT *, list_distinct(list_concat(list_filter(string_split_regex(lower(q), '\s+'), lambda x: x <> ''), {_TERMS})) AS ws FROM q) SELECT doc_id, round(least(1.0, len(list_filter(ws, lambda x: contains(t, x))) / len(ws) + CASE WHEN contains(lower(q), 'optimize') AND f THEN 0.2 WHEN contains(lower(q), 'fix') AND contains(t, 'error') THEN 0.3 ELSE 0.0 END), 6)::DOUBLE AS relevance FROM w")
def top8(spark, d):
    """Each text's first line asks, with one of two wishes or none, for the text as a chunk of code."""
    docs = documents(spark, d).filter("text IS NOT NULL")
    wish = F.element_at(F.array(F.lit("optimize "), F.lit("fix "), F.lit("")), (F.col("doc_id") % 3 + 1).cast("int"))
    code = F.concat("text", F.when(F.col("doc_id") % 5 == 0, " error").otherwise(""))
    return docs.select("doc_id", F.round(K.relevance(F.concat(wish, F.split("text", "\n", -1)[0]), code, F.when(F.col("doc_id") % 2 == 0, "function").otherwise("class")), 6).alias("relevance"))


@C("win6_retrieved", f"WITH {searches.KEYWORD}, r AS (SELECT *, {searches.RANK} FROM kw), t AS (SELECT qid, rank, id, text, coalesce(sum(length(text)) OVER (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM r JOIN documents ON doc_id = id WHERE rank <= 3 AND text <> '') SELECT qid, md5(string_agg('### From ' || id || ':' || chr(10) || substring(text, 1, (2000 - bef)::BIGINT) || CASE WHEN length(text) > 2000 - bef THEN chr(10) || '...(truncated)' ELSE '' END, chr(10) || chr(10) ORDER BY rank)) AS context FROM t WHERE bef < 2000 GROUP BY qid")
def win6(spark, d):
    """The three best hits of each question as one text of 2,000 characters and a mark where it was cut."""
    docs = documents(spark, d).filter("text <> ''").select(F.col("doc_id").alias("id"), "text")
    hits = searches.S.top_k(searches.keyword(spark, d), 3).hint("merge").join(docs, "id")
    parts = V.filled(hits, ["qid"], [F.col("rank")], "text", 2000, "\n...(truncated)")
    part = F.concat(F.lit("### From "), "id", F.lit(":\n"), "text")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))), lambda x: x["part"]), "\n\n")
    return parts.groupBy("qid").agg(F.md5(joined).alias("context"))
