"""Queries of tokenisers, text functions, rules, guards and filters."""

from __future__ import annotations

from ..functions import guards, rules, tokens
from ..sources import pages as P
from ._base import Catalog, F, quoted, read, sql_any, sql_first, sql_hits

C = Catalog()


def text():
    return F.col("text")


def plain():
    """The text with ? for everything that is not ASCII, where engines' word classes differ."""
    return F.regexp_replace("text", r"[^\x00-\x7F]", "?")


TOKENS = r"list_filter(regexp_extract_all(lower(text), '[a-zA-Z_][a-zA-Z0-9_]*|[0-9]+'), lambda x: length(x) > 2)"
STOPS = ", ".join(map(quoted, tokens.STOPWORDS))
BLANK = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"

C.columns("txt1_code_tokens", "documents", ["doc_id"], lambda: {"n": F.size(tokens.code_tokens(text())), "h": F.md5(F.array_join(tokens.code_tokens(text()), " "))},
          f"SELECT doc_id, len({TOKENS})::INT AS n, md5(array_to_string({TOKENS}, ' ')) AS h FROM documents")
WORDS = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+'), lambda x: regexp_matches(x, '^[a-z_][a-z0-9_]{2,}$'))"
C.columns("txt2_index_words", "documents", ["doc_id"], lambda: {"n": F.size(tokens.index_words(text())), "h": F.md5(F.array_join(tokens.index_words(text()), " "))},
          f"SELECT doc_id, len({WORDS})::INT AS n, md5(array_to_string({WORDS}, ' ')) AS h FROM documents")
TERMS = rf"list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_\s.\-\[\]]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: length(x) > 2 AND x NOT IN ({STOPS}))"
C.columns("txt3_terms", "documents", ["doc_id"], lambda: {"n": F.size(tokens.terms(text())), "h": F.md5(F.array_join(tokens.terms(text()), " "))},
          f"SELECT doc_id, len({TERMS})::INT AS n, md5(array_to_string({TERMS}, ' ')) AS h FROM documents")
IDENT = r"list_filter(regexp_extract_all(lower(text), '[a-zA-Z_][\p{L}\p{N}_]*'), lambda x: length(x) >= 3)"
C.columns("txt4_identifiers", "documents", ["doc_id"], lambda: {"n": F.size(tokens.identifiers(text())), "h": F.md5(F.array_join(tokens.identifiers(text()), " "))},
          f"SELECT doc_id, len({IDENT})::INT AS n, md5(array_to_string({IDENT}, ' ')) AS h FROM documents")
C.columns("txt5_blank_split", "documents", ["doc_id"], lambda: {"n": F.size(tokens.blank_split(text())), "first": tokens.blank_split(text())[0]},
          f"SELECT doc_id, len(string_split({BLANK}, ' '))::INT AS n, string_split({BLANK}, ' ')[1] AS first FROM documents")
NOISE_SQL = "(?i)\\b(" + "|".join(tokens.NOISE) + ")\\b"


def entities_sql(text: str) -> str:
    for entity, char in tokens.ENTITIES.items():
        text = f"replace({text}, {quoted(entity)}, {quoted(char)})"
    return text


ASCII = r"regexp_replace({0}, '[^\x00-\x7F]', '?', 'g')"
NO_NOISE = r"regexp_replace({0}, '" + NOISE_SQL + r"', '', 'g')"
SPACED = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
C.columns("txt7_without_noise", "documents", ["doc_id"], lambda: {"h": F.md5(tokens.normalised(tokens.without_noise(tokens.unescaped(plain()))))},
          f"SELECT doc_id, md5({SPACED.format(NO_NOISE.format(entities_sql(ASCII.format('text'))))}) AS h FROM documents")
PAGE = entities_sql("regexp_replace(" + ASCII.format("html") + ", '<[^>]+>', ' ', 'g')")
C.columns("txt8_plain_pages", "pages", ["page_id"], lambda: {"h": F.md5(tokens.plain_page(F.regexp_replace("html", r"[^\x00-\x7F]", "?")))},
          f"SELECT page_id, md5(substring({NO_NOISE.format(SPACED.format(PAGE))}, 1, 10000)) AS h FROM pages")
C.columns("txt9_normalised", "documents", ["doc_id"], lambda: {"n": F.length(tokens.normalised(text())), "h": F.md5(tokens.normalised(text()))},
          r"SELECT doc_id, length(trim(regexp_replace(text, '\s+', ' ', 'g')))::INT AS n, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS h FROM documents")
C.columns("txt10_indented_blocks", "documents", ["doc_id"], lambda: {"n": F.size(F.regexp_extract_all(F.replace(text(), F.lit(". "), F.lit(".\n    ")), F.lit("(?m)^(    .*)$"), 1))},
          r"SELECT doc_id, len(regexp_extract_all(replace(text, '. ', '.' || chr(10) || '    '), '(?m)^(    .*)$'))::INT AS n FROM documents")
C.columns("txt11_density", "documents", ["doc_id"], lambda: {"density": F.round(F.length(F.regexp_replace(text(), r"[^\p{L}\p{N}.!?]", "")) / F.length(text()), 4), "hint": F.substring(text(), 1, 200)},
          r"SELECT doc_id, round(length(regexp_replace(text, '[^\p{L}\p{N}.!?]', '', 'g')) / length(text), 4) AS density, substring(text, 1, 200) AS hint FROM documents")
C.columns("txt13_sentences", "documents", ["doc_id"], lambda: {"n": F.size(F.filter(F.split(text(), r"[.!?]\s+"), lambda s: F.length(s) > 20)), "summary": F.substring(F.split(text(), r"[.!?]\s+")[0], 1, 100)},
          r"SELECT doc_id, len(list_filter(string_split_regex(text, '[.!?]\s+'), lambda s: length(s) > 20))::INT AS n, substring(string_split_regex(text, '[.!?]\s+')[1], 1, 100) AS summary FROM documents")
C.columns("txt14_first_lines", "documents", ["doc_id"], lambda: {"h": F.md5(F.array_join(F.slice(F.split(text(), "\n", -1), 1, 30), "\n"))},
          r"SELECT doc_id, md5(array_to_string(list_slice(string_split(text, chr(10)), 1, 30), chr(10))) AS h FROM documents")
C.columns("txt15_hashes", "documents", ["doc_id"], lambda: {"md5": F.md5(text()), "sha256": F.sha2(text(), 256)}, "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
C.columns("txt16_chunk_ids", "documents", ["doc_id"], lambda: {"chunk_id": F.substring(F.md5(F.concat_ws(":", F.concat_ws("/", "source", "doc_id"), F.lit("1"))), 1, 12)},
          "SELECT doc_id, substring(md5(source || '/' || doc_id || ':1'), 1, 12) AS chunk_id FROM documents")
C.columns("txt17_key_terms", "conversations", ["conv_id", "turn"], lambda: {"terms": F.array_join(tokens.key_terms(text()), " ")},
          r"WITH k AS (SELECT conv_id, turn, text, list_filter([" + ", ".join(map(quoted, tokens.KEY_TERMS)) + r"], lambda k: contains(lower(text), k)) AS f FROM conversations) SELECT conv_id, turn, array_to_string(CASE WHEN len(f) > 0 THEN f ELSE list_slice(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), 1, 5) END, ' ') AS terms FROM k")
C.columns("txt18_rendered", "documents", ["doc_id"], lambda: {"h": F.md5(F.concat_ws("\n", F.concat(F.lit("Source: "), "source"), F.when(F.col("lang") != "en", F.concat(F.lit("Type: "), "lang")), F.lit(""), text()))},
          "SELECT doc_id, md5(concat_ws(chr(10), 'Source: ' || source, CASE WHEN lang <> 'en' THEN 'Type: ' || lang END, '', text)) AS h FROM documents")
C.columns("agg23_analysis_lines", "documents", ["doc_id"], lambda: {"issues": F.size(F.filter(F.split(F.lower(text()), "\n", -1), lambda x: x.contains("issue") | x.contains("the"))), "recommendations": F.size(F.filter(F.split(F.lower(text()), "\n", -1), lambda x: x.contains("recommend")))},
          "SELECT doc_id, len(list_filter(string_split(lower(text), chr(10)), lambda x: contains(x, 'issue') OR contains(x, 'the')))::INT AS issues, len(list_filter(string_split(lower(text), chr(10)), lambda x: contains(x, 'recommend')))::INT AS recommendations FROM documents")

# rules over the turns of conversations
KEY = ["conv_id", "turn"]
FROM = " FROM conversations"


def _turns(name, spark_columns, sql_columns):
    C.columns(name, "conversations", KEY, spark_columns, "SELECT conv_id, turn, " + sql_columns + FROM)


def _route_sql() -> str:
    total = sum(map(len, rules.ROUTES.values()))
    cols = []
    for name, patterns in rules.ROUTES.items():
        n = " + ".join(f"regexp_matches(text, {quoted('(?i)' + p)})::INT" for p in patterns)
        boost = {"godot_specific": "CASE WHEN contains(lower(text), 'godot') THEN 1.5 ELSE 1.0 END", "coding_fix": f"CASE WHEN {sql_any('text', ['error', 'exception', 'traceback'])} THEN 1.3 ELSE 1.0 END"}.get(name, "1.0")
        cols.append(f"(({n}) * ({boost}))::DOUBLE AS s_{name}")
    s = [f"s_{n}" for n in rules.ROUTES]
    best = f"greatest({', '.join(s)})"
    pick = " ".join(f"WHEN s_{n} = {best} THEN '{n}'" for n in rules.ROUTES)
    second = f"list_sort([{', '.join(s)}], 'DESC')[2]"
    return (
        f"WITH a AS (SELECT conv_id, turn, regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g') AS text FROM conversations), s AS (SELECT conv_id, turn, {', '.join(cols)} FROM a) "
        f"SELECT conv_id, turn, CASE WHEN {best} <= 0 THEN 'unknown' {pick} END AS query_type, round_even(least(1.0, greatest({best}, 0) / ({total} * 0.1)), 2) AS confidence, "
        f"CASE WHEN {best} <= 0 THEN 'none' WHEN {best} > {second} * 2 THEN 'high' WHEN {best} > {second} THEN 'moderate' ELSE 'open' END AS margin FROM s"
    )


# patterns with \b and \s mean the same in both engines on ASCII text only
C.columns("cls1_route", "conversations", KEY, lambda: rules.route(plain()), _route_sql())


@C("cls2_handlers", f"WITH r AS ({_route_sql()}) SELECT CASE query_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.HANDLERS.items()) + " ELSE 'general_assistant' END AS handler, count(*) AS n FROM r GROUP BY 1")
def cls2(spark, d):
    kind = rules.route(plain())["query_type"]
    return read(spark, d, "conversations").select(rules.handler(kind).alias("handler")).groupBy("handler").agg(F.count("*").alias("n"))


_scores = {n: sql_hits("text", w) for n, w in rules.INTENTS.items()}
_top = f"greatest({', '.join(_scores.values())})"
_turns("cls3_keyword_intent", lambda: rules.intent(text()),
       f"CASE WHEN {_top} < 2 THEN 'general' " + " ".join(f"WHEN {s} = {_top} THEN '{n}'" for n, s in _scores.items()) + f" END AS intent, CASE WHEN {_top} < 2 THEN 0.1 ELSE least(0.7, round({_top} * 0.2, 2)) END::DOUBLE AS confidence")
_turns("cls6_mode", lambda: {"mode": rules.first_match(text(), rules.MODES, "casual"), "casual": rules.casual(text())},
       f"{sql_first('text', rules.MODES, 'casual')} AS mode, CASE WHEN length(trim(text)) < 6 THEN NOT ({sql_any('text', ['fix', 'bug', 'error', 'explain', 'what', 'how'])}) ELSE NOT ({sql_any('text', ['fix', 'bug', 'error', 'debug', 'explain', 'what', 'how', 'analyze', 'why', 'list', 'find', 'issues'])}) AND {sql_any('text', rules.CASUAL)} END AS casual")
FAST_SQL = rf"CASE WHEN regexp_matches(lower(text), '^(hi|hello|hey|good morning|good afternoon|good evening)') THEN 'greeting' WHEN {sql_any('text', rules.STATUS)} THEN 'status' WHEN regexp_matches(lower(text), '^(help|what can you do|how do i use|commands)') THEN 'quick_help' WHEN {sql_any('text', rules.EXPLAINING)} THEN 'explain' ELSE 'chat' END"
_turns("cls7_fast_intent", lambda: {"intent": rules.fast_intent(text())}, f"{FAST_SQL} AS intent")
_turns("cls8_complex_intent", lambda: {"intent": rules.first_match(text(), rules.COMPLEX, "chat")}, f"{sql_first('text', rules.COMPLEX, 'chat')} AS intent")
_turns("cls9_task", lambda: {"action": rules.first_match(text(), rules.ACTIONS, "chat"), "target": F.regexp_extract(F.lower(text()), r"([a-z0-9_\-]+\.gd)", 1)},
       rf"{sql_first('text', rules.ACTIONS, 'chat')} AS action, regexp_extract(lower(text), '([a-z0-9_\-]+\.gd)', 1) AS target")
_turns("cls11_error_types", lambda: {"error_type": rules.first_match(text(), rules.ERRORS, "none"), "severity": F.when(tokens.any_of(text(), rules.CRITICAL), "critical").otherwise("medium")},
       f"{sql_first('text', rules.ERRORS, 'none')} AS error_type, CASE WHEN {sql_any('text', rules.CRITICAL)} THEN 'critical' ELSE 'medium' END AS severity")
_turns("cls12_requirements", lambda: {"fast": tokens.any_of(text(), rules.FAST), "effort": rules.first_match(text(), rules.EFFORT, "medium"), "tests": tokens.any_of(text(), ["test"])},
       f"{sql_any('text', rules.FAST)} AS fast, {sql_first('text', rules.EFFORT, 'medium')} AS effort, {sql_any('text', ['test'])} AS tests")
_turns("cls13_expertise", lambda: {"level": rules.first_match(text(), rules.EXPERTISE, "intermediate")}, f"{sql_first('text', rules.EXPERTISE, 'intermediate')} AS level")
_heat = sql_first("text", rules.COMPLEX, "chat")
_turns("cls14_temperature", lambda: rules.temperature(text(), rules.first_match(text(), rules.COMPLEX, "chat"), F.col("turn")),
       "CASE " + " ".join(f"WHEN ({_heat}) IN ({own}) OR {sql_any('text', w)} THEN {t}" for (w, t, _), own in zip(rules.TEMPERATURES, ["'debug', 'fix'", "'build', 'create'", "'explain'", "'analyze'"])) + f" WHEN ({_heat}) = 'chat' AND turn > 3 THEN 0.65 ELSE 0.5 END::DOUBLE AS temperature, "
       "CASE " + " ".join(f"WHEN ({_heat}) IN ({own}) OR {sql_any('text', w)} THEN {str(m).lower()}" for (w, _, m), own in zip(rules.TEMPERATURES, ["'debug', 'fix'", "'build', 'create'", "'explain'", "'analyze'"])) + f" ELSE ({_heat}) = 'chat' AND turn > 3 END AS samples")  # fmt: skip
_turns("cls15_question_type", lambda: {"kind": rules.first_match(text(), rules.QUESTIONS, "general")}, f"{sql_first('text', rules.QUESTIONS, 'general')} AS kind")


@C("cls16_agg25_routes", f"SELECT CASE WHEN {sql_any('text', rules.DOMAIN_ROUTE)} THEN 'expert' ELSE 'general' END AS handler, count(*) AS n, round(avg(length(text)), 4) AS mean_chars FROM conversations GROUP BY 1")
def cls16(spark, d):
    to = F.when(tokens.any_of(text(), rules.DOMAIN_ROUTE), "expert").otherwise("general")
    return read(spark, d, "conversations").groupBy(to.alias("handler")).agg(F.count("*").alias("n"), F.round(F.avg(F.length("text")), 4).alias("mean_chars"))


_turns("flt7_domain", lambda: {"related": rules.in_domain(text())}, f"{sql_any('text', rules.STRONG)} OR {sql_hits('text', rules.DOMAIN)} >= 1 AS related")
_turns("flt9_topic_word", lambda: {"topic": rules.topic_word(text())},
       rf"coalesce(list_filter(string_split({BLANK}, ' '), lambda w: length(w) > 3 AND w NOT IN ({', '.join(map(quoted, rules.TOPIC_STOP))}))[1], 'that topic') AS topic")
_turns("flt6_truncated", lambda: {"query": F.substring(text(), 1, 200), "snippet": F.substring(text(), 1, 150)}, "substring(text, 1, 200) AS query, substring(text, 1, 150) AS snippet")

_turns("flt8_strict_domain", lambda: {"related": rules.in_domain_strictly(text())}, f"NOT ({sql_any('text', rules.OFF_TOPIC)} AND NOT {sql_any('text', ['godot', 'gdscript'])}) AND {sql_hits('text', rules.DOMAIN_2)} > 0 AS related")
_kinds = {n: sql_hits("text", w) for n, w in rules.KINDS.items()}
_most = f"greatest({', '.join(_kinds.values())})"
_turns("cls4_kind", lambda: rules.kind(text()), f"CASE WHEN {_most} = 0 THEN 'general' " + " ".join(f"WHEN {s} = {_most} THEN '{n}'" for n, s in _kinds.items()) + f" END AS kind, round(least({_most} / 3, 1.0), 4)::DOUBLE AS confidence")
C.columns("cls10_reduced", "documents", ["doc_id"], lambda: {"focus": F.coalesce(rules.reduced(text())[0], F.lit("code structure"))},
          "SELECT doc_id, CASE " + " ".join(f"WHEN {sql_any('text', w)} THEN '{f}'" for w, f, _, _ in rules.REDUCTIONS) + " ELSE 'code structure' END AS focus FROM documents")

# guards
AG = r"regexp_replace(text, '[^\x00-\x7F]', '?', 'g')"
INJ = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({AG}, {quoted(p)}) THEN {quoted(p)} END" for p in guards.INJECTION) + "], lambda x: x IS NOT NULL)"
@C("grd1_injection", f"WITH m AS (SELECT doc_id, {INJ} AS m FROM documents) SELECT doc_id, len(m)::INT AS n, least(1.0, len(m) / 2.0)::DOUBLE AS confidence, len(m) > 0 AS flagged FROM m")
def grd1(spark, d):
    """The patterns are looked for once a text, and the three columns read what was found."""
    found = read(spark, d, "documents").select("doc_id", F.size(guards.injection(plain())["matched"]).alias("n"))
    return found.select("doc_id", "n", F.least(F.lit(1.0), F.col("n") / 2).alias("confidence"), (F.col("n") > 0).alias("flagged"))


def _chain(patterns, marks, text):
    for p, m in zip(patterns, marks):
        text = f"regexp_replace({text}, {quoted(p)}, '{m}', 'g')"
    return text


C.columns("grd2_redacted", "documents", ["doc_id"], lambda: {"h": F.md5(guards.redacted(plain()))}, f"SELECT doc_id, md5({_chain(guards.INJECTION, ['[REDACTED]'] * 18, AG)}) AS h FROM documents")
C.columns("grd3_verdict", "documents", ["doc_id"], lambda: {"reason": guards.verdict(plain())},
          f"WITH m AS (SELECT doc_id, text, {INJ} AS m FROM documents) SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN 'empty' WHEN length(text) > 10000 THEN 'too long' WHEN len(m) > 0 THEN 'suspicious ' || format('{{:.2f}}', least(1.0, len(m) / 2.0)) ELSE '' END AS reason FROM m")
MASK = _chain(guards.SECRETS.values(), [f"[REDACTED_{k}]" for k in guards.SECRETS], AG)
C.columns("grd4_masked", "documents", ["doc_id"], lambda: {"h": F.md5(guards.masked(plain())), "found": guards.masked(plain()) != plain()}, f"SELECT doc_id, md5({MASK}) AS h, {MASK} <> {AG} AS found FROM documents")


@C("grd5_input_pipeline", f"WITH m AS (SELECT source, {INJ} AS m, {MASK} <> {AG} AS s FROM documents) SELECT source, count(*) FILTER (WHERE len(m) > 0) AS blocked, count(*) FILTER (WHERE len(m) = 0 AND s) AS masked, count(*) FILTER (WHERE len(m) = 0 AND NOT s) AS clean FROM m GROUP BY source")
def grd5(spark, d):
    rows = read(spark, d, "documents").select("source", guards.injection(plain())["flagged"].alias("bad"), (guards.masked(plain()) != plain()).alias("secret"))
    return rows.groupBy("source").agg(F.count_if("bad").alias("blocked"), F.count_if(~F.col("bad") & F.col("secret")).alias("masked"), F.count_if(~F.col("bad") & ~F.col("secret")).alias("clean"))


C.columns("grd6_output", "documents", ["doc_id"], lambda: {"h": F.md5(guards.without_commands(text()))}, r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '\$\([^)]+\)', '[REMOVED]', 'g'), '`[^`]+`', '[REMOVED]', 'g')) AS h FROM documents")
C.columns("lnt12_danger", "documents", ["doc_id"], lambda: {"reason": guards.danger(plain())}, "SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches({AG}, {quoted(p)}) THEN {quoted(p)}" for p in guards.DANGEROUS) + " ELSE '' END AS reason FROM documents")


# pages
@C("flt11_txt6_agg22_distilled")
def distilled(spark, d):
    pages = read(spark, d, "pages")
    out = P.distilled(pages).filter(F.length("content") >= 50).withColumn("density", tokens.density(F.col("content"))).filter("density >= 0.3")
    sizes = pages.filter(F.length("html") >= 100).select("page_id", F.length("html").alias("original"))
    return out.hint("merge").join(sizes, "page_id").select("page_id", "blocks", "density", "original", F.length("content").alias("distilled"), F.round(F.length("content") / F.col("original"), 4).alias("ratio"), F.md5("content").alias("h"))


C.columns("scl6_url_parts", "pages", ["page_id"], lambda: {"host": F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1), "stem": F.regexp_extract("url", r"([^/?#]+)(?:[?#].*)?$", 1)},
          "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '([^/?#]+)(?:[?#].*)?$', 1) AS stem FROM pages")
