"""Queries of answers and requests: code in answers, bullets, caps, headers, lenient JSON, the second rule sets; scenes
with their scripts. Requests are turns behind an opening, answers are documents in a fence or without one."""

from __future__ import annotations

from ..functions import rules, shapes
from ..operators import analysis as A
from ..operators import code as K
from ..sources import pluggable
from ._base import Catalog, F, quoted, read, sql_any, sql_first

C = Catalog()

OPENINGS = ["", "Hello ", "  status ", "how many scripts ", "thanks ", "explain ", "optimize player.gd ", "review Game-1.gd ", "create ", "what is the meaning"]


def _one_of(values, key):
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def _one_of_sql(values, key):
    return f"list_extract([{', '.join(map(quoted, values))}], (({key}) % {len(values)} + 1)::INT)"


ASKED = f"q AS (SELECT conv_id, turn, {_one_of_sql(OPENINGS, 'conv_id + turn')} || CASE WHEN (conv_id + turn) % {len(OPENINGS)} = {len(OPENINGS) - 1} THEN '' ELSE regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g') END AS text FROM conversations)"


def asked(spark, d):
    t = read(spark, d, "conversations")
    key = F.col("conv_id") + F.col("turn")
    body = F.when(key % len(OPENINGS) == len(OPENINGS) - 1, "").otherwise(F.regexp_replace("text", r"[^\x00-\x7F]", "?"))
    return t.select("conv_id", "turn", F.concat(_one_of(OPENINGS, key), body).alias("text"))


def _asked(name, spark_columns, sql):
    @C(name, f"WITH {ASKED} SELECT conv_id, turn, {sql} FROM q")
    def query(spark, d):
        return asked(spark, d).select("conv_id", "turn", *[c.alias(n) for n, c in spark_columns(F.col("text")).items()])


def _set_sql(name, patterns):
    test = "(" + " OR ".join(f"regexp_matches(trim(text), {quoted('(?i)' + p)})" for p in patterns) + ")"
    return f"WHEN {test}" + (" AND length(trim(text)) < 60" if name == "explain" else "") + f" THEN '{name}'"


NAMED = r"regexp_matches(lower(text), '[\w\-]+\.gd')"
INTENT = f"CASE WHEN {sql_any('text', rules.FILE_DEBUG)} THEN 'debug' WHEN {sql_any('text', rules.FILE_BUILD)} THEN 'build' WHEN {NAMED} AND {sql_any('text', rules.FILE_CHANGE + rules.FILE_ANALYZE)} THEN 'generate' WHEN {sql_any('text', rules.FILE_ANALYZE)} THEN 'analyze' ELSE 'chat' END"
_asked("cls7_fast_intent_by_patterns", lambda t: {"intent": rules.fast_intent_by_patterns(t)}, "CASE " + " ".join(_set_sql(k, p) for k, p in rules.FAST_2.items()) + " ELSE 'complex' END AS intent")
_asked("cls8_file_aware_intent", lambda t: {"intent": rules.file_aware_intent(t)}, f"{INTENT} AS intent")
_asked("flt10_script_names", lambda t: {"name": rules.file_name(t)}, r"nullif(regexp_extract(lower(text), '([\w\-]+\.gd)', 1), '') AS name")
_level = sql_first("text", rules.EXPERTISE, "intermediate")
_asked("cls13_response_style", lambda t: {k: rules.response_style(rules.first_match(t, rules.EXPERTISE, "intermediate"), F.col("turn") % 11 / 10)[k] for k in ("style", "detail", "tone")},
       f"CASE {_level} WHEN 'beginner' THEN 'educational' WHEN 'advanced' THEN 'concise' ELSE 'balanced' END AS style, CASE {_level} WHEN 'beginner' THEN 'high' WHEN 'advanced' THEN 'low' ELSE 'medium' END AS detail, CASE WHEN turn % 11 / 10 > 0.7 THEN 'creative' WHEN turn % 11 / 10 < 0.3 THEN 'precise' ELSE 'balanced' END AS tone")


def _reduced_sql(k):
    own = " ".join(f"WHEN {sql_any('text', r[0])} THEN {quoted(r[k + 1])}" for r in rules.REDUCTIONS)
    return f"CASE {own} " + " ".join(f"WHEN action = '{a}' THEN {quoted(f[k])}" for a, f in rules.BY_ACTION.items()) + " END"


@C("cls10_reduced_task", f"WITH {ASKED}, a AS (SELECT *, CASE WHEN {sql_any('text', ['optimize'])} THEN 'optimize' ELSE {INTENT} END AS action FROM q) SELECT conv_id, turn, {_reduced_sql(0)} AS focus, {_reduced_sql(1)} AS instruction, {_reduced_sql(2)} AS most FROM a")
def cls10(spark, d):
    t = F.col("text")
    action = F.when(F.lower(t).contains("optimize"), "optimize").otherwise(rules.file_aware_intent(t))
    out = asked(spark, d).select("conv_id", "turn", rules.reduced_task(t, action).alias("r"))
    return out.select("conv_id", "turn", "r.focus", "r.instruction", F.col("r.limit").alias("most"))


HEADS = ["Here:\n```gdscript\n", "See\n```\n", "", "var a = 1\nIssue: slow\n- one point\n* other point\n    indented = 1\n", "Recommendation: test\n", "```py\n"]
TAILS = ["\n```\nend", "\n```", "", "\n\tfunc b():\n3. third\n", "\n", "\n```\nand\n```\nmore\n```"]


def _c(v):
    return quoted(v).replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '")


MADE = "d AS (SELECT doc_id, source, lang, CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN {_c(a)} || text || {_c(b)}" for i, (a, b) in enumerate(zip(HEADS, TAILS))) + " END AS text FROM documents)"


def made(spark, d):
    return read(spark, d, "documents").select("doc_id", "source", "lang", F.concat(_one_of(HEADS, F.col("doc_id")), "text", _one_of(TAILS, F.col("doc_id"))).alias("text"))


def _made(name, spark_columns, sql):
    @C(name, f"WITH {MADE} SELECT doc_id, {sql} FROM d")
    def query(spark, d):
        return made(spark, d).select("doc_id", *[c.alias(n) for n, c in spark_columns(F.col("text")).items()])


STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_looks = "list_filter(string_split(text, chr(10)), lambda x: " + " OR ".join(f"starts_with(ltrim(x, ' '), '{k}')" for k in shapes.CODE_STARTS) + " OR contains(x, '='))"
_blocks = r"list_concat(regexp_extract_all(text, '(?s)```(?:\w+)?\n(.*?)```', 1), regexp_extract_all(text, '(?m)^(    .*)$', 1))"
_made("txt10_code_blocks", lambda t: {"n": F.size(shapes.code_blocks(t)), "h": F.md5(F.array_join(shapes.code_blocks(t), "|"))},
      f"len({_blocks})::INT AS n, md5(array_to_string({_blocks}, '|')) AS h")
_made("txt12_code_of_answers", lambda t: {"h": F.md5(shapes.code_of(t))},
      "md5(CASE WHEN NOT regexp_matches(text, '\\S') THEN '' WHEN regexp_matches(text, '(?is)```gdscript(.*?)```') THEN " + STRIP.format("regexp_extract(text, '(?is)```gdscript(.*?)```', 1)") + " WHEN regexp_matches(text, '(?s)```(.*?)```') THEN " + STRIP.format("regexp_extract(text, '(?s)```(.*?)```', 1)") + f" WHEN len({_looks}) > 0 THEN " + STRIP.format(f"array_to_string(list_slice({_looks}, 1, 40), chr(10))") + " ELSE substring(text, 1, 500) END) AS h")
_made("txt13_bullets", lambda t: {"h": F.md5(F.array_join(shapes.bullets(t), "|")), "summary": shapes.summary(t)},
      r"md5(array_to_string(list_slice(CASE WHEN regexp_matches(text, '(?m)^(?:[-*•]|\d+\.)[ \t]+(.+)$') THEN regexp_extract_all(text, '(?m)^(?:[-*•]|\d+\.)[ \t]+(.+)$', 1) ELSE list_transform(list_filter(string_split_regex(text, '[.!?]\s+'), lambda s: length(" + STRIP.format("s") + ") > 20 AND NOT starts_with(s, '#')), lambda s: " + STRIP.format("s") + r") END, 1, 5), '|')) AS h, CASE WHEN length(string_split_regex(text, '[.!?]\s+')[1]) > 100 THEN substring(string_split_regex(text, '[.!?]\s+')[1], 1, 97) || '...' ELSE string_split_regex(text, '[.!?]\s+')[1] END AS summary")
_made("txt14_capped_lines", lambda t: {"h": F.md5(shapes.capped_lines(t, 10))},
      "md5(CASE WHEN len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) > 10 THEN array_to_string(list_slice(string_split(regexp_replace(text, '\\n$', ''), chr(10)), 1, 10), chr(10)) || chr(10) || '# [OUTPUT TRUNCATED: max lines reached]' ELSE text END) AS h")
_made("txt18_chunk_context", lambda t: {"h": F.md5(shapes.chunk_context(F.col("source"), F.lit("doc"), F.col("doc_id") % 3, F.col("doc_id"), F.when(F.col("doc_id") % 2 == 0, F.lit("function")), F.when(F.col("doc_id") % 5 == 0, F.lit("root")), t))},
      "md5(concat_ws(chr(10), '# Source: ' || source || ' (doc)', CASE WHEN doc_id % 3 > 0 THEN '# Lines: ' || (doc_id % 3) || '-' || doc_id END, CASE WHEN doc_id % 2 = 0 THEN '# Type: function' END, CASE WHEN doc_id % 5 = 0 THEN '# Parent: root' END, '', text)) AS h")
_made("agg23_marked_lines", lambda t: {"issues": shapes.analysis_lines(t)["issues"], "recommendations": shapes.analysis_lines(t)["recommendations"], "insights": F.array_join(shapes.analysis_lines(t)["insights"], "|")},
      "len(list_filter(string_split(lower(text), chr(10)), lambda x: contains(x, 'issue')))::INT AS issues, len(list_filter(string_split(lower(text), chr(10)), lambda x: contains(x, 'recommend')))::INT AS recommendations, array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: " + " OR ".join(f"contains(x, '{m}')" for m in shapes.INSIGHTS) + "), lambda s: " + STRIP.format("s") + "), '|') AS insights")


@C("scl5_lenient_json", "WITH t AS (SELECT event_id, event_id % 5 AS k, event_type FROM events) SELECT event_id, CASE WHEN k = 4 THEN NULL ELSE event_type END AS kind, CASE WHEN k = 4 THEN NULL WHEN k = 0 THEN 'false' ELSE 'true' END AS flag FROM t")
def scl5(spark, d):
    """Each event's type in an answer: as JSON, in a fence, within words, with commas and names of another language, or broken."""
    k = F.col("event_id") % 5
    body = F.concat(F.lit('{"kind": "'), "event_type", F.lit('", "flag": '))
    wrapped = (
        F.when(k == 0, F.concat(body, F.lit("false}"))).when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("True,}\n```")))
        .when(k == 2, F.concat(F.lit("Result: "), body, F.lit('True, "x": [1, 2,], "y": None} done'))).when(k == 3, F.concat(body, F.lit("true,\n}")))
        .otherwise(F.concat(body, F.lit(": }")))
    )
    j = read(spark, d, "events").select("event_id", shapes.lenient_json(wrapped).alias("j"))
    return j.select("event_id", F.get_json_object("j", "$.kind").alias("kind"), F.get_json_object("j", "$.flag").alias("flag"))


SCENES = "l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INT AS i FROM documents), sn AS MATERIALIZED (SELECT source || '/' || doc_id || '.tscn' AS scene, 'n' || i AS node, source || '/s' || (length(line) % 40) || '.gd' AS script FROM l WHERE i % 2 = 1)"


def attached(spark, d):
    """Scenes of documents: every other line is a node with a script of its source."""
    rows = read(spark, d, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("p", "line")).withColumn("i", F.col("p") + 1)
    at = lambda *c: F.concat("source", F.lit("/"), *c)
    id_ = F.concat(F.lit("r"), "i")
    res = F.concat(F.lit('[ext_resource type="Script" path="res://'), at(F.lit("s"), F.length("line") % 40, F.lit(".gd")), F.lit('" id="'), id_, F.lit('"]'))
    node = F.concat(F.lit('[node name="n'), "i", F.lit('" type="Node2D"]'))
    prop = F.concat(F.lit('script = ExtResource("'), id_, F.lit('")'))
    three = F.posexplode(F.array(res, node, prop)).alias("k", "line")
    lines = rows.filter("i % 2 = 1").select(at("doc_id", F.lit(".tscn")).alias("path"), "i", three)
    return A.attachments(K.scene_rows(lines.select("path", (F.col("i") * 3 + F.col("k")).alias("line_no"), "line")))


@C("jn4_grf7_script_usage", f"WITH {SCENES} SELECT script, scene, node FROM sn")
def jn4(spark, d):
    return attached(spark, d)


@C("agg15_most_used_scripts", f"WITH {SCENES} SELECT script, count(DISTINCT scene) AS scenes, count(*) AS nodes FROM sn GROUP BY script ORDER BY scenes DESC, script LIMIT 5")
def agg15(spark, d):
    """The five scripts that most scenes use."""
    return attached(spark, d).groupBy("script").agg(F.countDistinct("scene").alias("scenes"), F.count("*").alias("nodes")).orderBy(F.desc("scenes"), "script").limit(5)


@C("src12_shaped_entries", "WITH e AS (SELECT DISTINCT 'Topic: ' || lang || chr(10) || 'Source: ' || source || chr(10) || chr(10) || text AS content FROM documents WHERE lang IS NOT NULL AND doc_id % 7 <> 0 AND length(trim(text)) > 0) SELECT md5(content) AS hash, length(content)::INT AS n FROM e")
def src12(spark, d):
    """Documents as entries on their language; every seventh lacks its extract."""
    rows = read(spark, d, "documents").filter("lang IS NOT NULL").select(F.col("lang").alias("topic"), "source", F.when(F.col("doc_id") % 7 != 0, F.col("text")).alias("extract"))
    return pluggable.entries(rows).select("hash", F.length("content").alias("n"))
