"""Queries of the index, search and set operators. The benchmark's items are the questions."""

from __future__ import annotations

from pyspark.sql.window import Window as W

from ..functions import tokens
from ..operators import search as S
from ..operators import windows as V
from ..operators.overlap import most_shared, shared_with_before
from ..operators.scratch import dealt, sized, written
from ._base import Catalog, F, read

C = Catalog()
D = r"tok AS (SELECT doc_id AS id, unnest(list_filter(regexp_extract_all(lower(text), '[a-zA-Z_][a-zA-Z0-9_]*|[0-9]+'), lambda x: length(x) > 2)) AS token FROM documents), post AS (SELECT id, token, count(*) AS tf FROM tok GROUP BY ALL)"
Q = r"ask AS (SELECT DISTINCT item_id AS qid, unnest(list_filter(regexp_extract_all(lower(text), '[a-zA-Z_][a-zA-Z0-9_]*'), lambda x: length(x) > 2)) AS token FROM benchmark)"
RANK = "row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank"


def posts(spark, d):
    return S.postings(read(spark, d, "documents"))


def asked(spark, d):
    return S.query_tokens(read(spark, d, "benchmark"))


@C("agg1_token_frequency", f"WITH {D} SELECT id, token, tf FROM post")
def agg1(spark, d):
    return posts(spark, d)


@C("agg2_capped_frequency", f"WITH {D} SELECT id, sum(least(tf, 10))::BIGINT AS capped, sum(tf)::BIGINT AS word_count, count(*) AS unique_words FROM post GROUP BY id")
def agg2(spark, d):
    return posts(spark, d).groupBy("id").agg(F.sum(F.least("tf", F.lit(10))).alias("capped"), F.sum("tf").alias("word_count"), F.count("*").alias("unique_words"))


@C("agg3_signature", r"WITH t AS (SELECT doc_id AS id, list_filter(regexp_extract_all(lower(text), '[a-zA-Z_][a-zA-Z0-9_]*|[0-9]+'), lambda x: length(x) > 2) AS l FROM documents), u AS (SELECT id, unnest(l) AS token, generate_subscripts(l, 1) AS p FROM t), g AS (SELECT id, token, count(*) AS tf, min(p) AS first FROM u GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tf DESC, first) AS r FROM g) SELECT id, string_agg(token, ':' ORDER BY r) AS signature FROM r WHERE r <= 10 GROUP BY id")
def agg3(spark, d):
    rows = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.posexplode(tokens.code_tokens(F.col("text"))).alias("p", "token"))
    return S.signature(rows.groupBy("id", "token").agg(F.count("*").alias("tf"), F.min("p").alias("first")))


def total(spark, d):
    return read(spark, d, "documents").agg(F.count("*").alias("n"))


@C("agg4_idf_smooth", f"WITH {D} SELECT token, count(*) AS df, round(ln((SELECT count(*) FROM documents) / (count(*) + 1)) + 1, 6) AS idf FROM post GROUP BY token")
def agg4(spark, d):
    return S.idf(posts(spark, d), total(spark, d), True).withColumn("idf", F.round("idf", 6))


@C("agg5_idf_plain", f"WITH {D} SELECT token, count(*) AS df, round(ln((SELECT count(*) FROM documents) / count(*)), 6) AS idf FROM post GROUP BY token")
def agg5(spark, d):
    return S.idf(posts(spark, d), total(spark, d), False).withColumn("idf", F.round("idf", 6))


@C("agg6_index_stats", f"WITH {D} SELECT count(DISTINCT id) AS documents, count(DISTINCT token) AS vocabulary, sum(tf)::BIGINT AS tokens FROM post")
def agg6(spark, d):
    return posts(spark, d).agg(F.countDistinct("id").alias("documents"), F.countDistinct("token").alias("vocabulary"), F.sum("tf").alias("tokens"))


KEYWORD = f"{D}, {Q}, kw AS (SELECT qid, id, sum(CASE WHEN lang = 'en' THEN 1 ELSE 2 END)::DOUBLE AS score FROM ask JOIN post USING (token) JOIN documents d ON d.doc_id = post.id GROUP BY ALL)"


def met(spark, d, questions=None):
    """Common tokens of the benchmark's questions and the documents; the language goes along, as it weighs the score."""
    questions = questions if questions is not None else read(spark, d, "benchmark")
    docs = read(spark, d, "documents").select("doc_id", "lang", "text")
    docs = dealt(docs, "doc_id", each=min(4_000, 1_000_000 // max(1, questions.count())))  # texts are dealt once; matches then stay where their document is, a million a task at most
    sets = S.token_sets(docs, "doc_id", keep=("lang",))
    return S.meetings(sets, S.token_sets(questions, "item_id", tokens=tokens.code_tokens(F.col("text"), numbers=False), name="qid"), "lang")


def keyword_of(met):
    """A document's weight is one number, so it comes in after the count."""
    return met.select("qid", "id", (F.col("both") * F.when(F.col("lang") == "en", 1).otherwise(2)).cast("double").alias("score"))


def keyword(spark, d):
    return keyword_of(met(spark, d))


@C("jn1_top2_keyword_search", f"WITH {KEYWORD}, r AS (SELECT *, {RANK} FROM kw) SELECT qid, id, score, rank FROM r WHERE rank <= 5")
def jn1(spark, d):
    return S.top_k(keyword(spark, d), 5)


@C("top1_one_query", f"WITH {KEYWORD} SELECT id, score FROM kw WHERE qid = (SELECT min(item_id) FROM benchmark) ORDER BY score DESC, id LIMIT 10")
def top1(spark, d):
    b = read(spark, d, "benchmark")
    first = b.join(F.broadcast(b.agg(F.min("item_id").alias("item_id"))), "item_id", "left_semi")
    return keyword_of(met(spark, d, first)).orderBy(F.desc("score"), "id").limit(10).select("id", "score")


JACCARD = f"{D}, {Q}, n AS (SELECT id, count(*) AS n FROM post GROUP BY id), m AS (SELECT qid, count(*) AS m FROM ask GROUP BY qid), b AS (SELECT qid, id, count(*) AS bo FROM ask JOIN post USING (token) GROUP BY ALL), j0 AS (SELECT qid, id, round(bo / (n + m - bo), 6) AS score FROM b JOIN n USING (id) JOIN m USING (qid)), jc AS (SELECT qid, id, round(score + CASE WHEN lang = 'en' THEN 0.0 ELSE 0.1 END, 6) AS score FROM j0 JOIN documents ON doc_id = id WHERE score > CASE WHEN lang = 'en' THEN 0.1 ELSE 0.15 END)"


def jaccard_of(spark, d, met):
    """Documents in other languages than English stand for knowledge, as in the keyword scores."""
    known = read(spark, d, "documents").filter("lang != 'en'").select(F.col("doc_id").alias("id"))
    return S.with_knowledge(S.jaccard_of(met), known)


def jaccard(spark, d):
    return jaccard_of(spark, d, met(spark, d))


@C("top3_flt3_jaccard_search", f"WITH {JACCARD}, r AS (SELECT *, {RANK} FROM jc) SELECT qid, id, score, rank FROM r WHERE rank <= 5")
def top3(spark, d):
    return S.top_k(jaccard(spark, d), 5)


ASK_TF = r"aw AS (SELECT item_id AS qid, unnest(list_filter(regexp_extract_all(lower(text), '[a-zA-Z_][a-zA-Z0-9_]*'), lambda x: length(x) > 2)) AS token FROM benchmark), atf AS (SELECT qid, token, count(*) AS tf FROM aw GROUP BY ALL)"


def asked_tf(spark, d):
    t = tokens.code_tokens(F.col("text"), numbers=False)
    return read(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.explode(t).alias("token")).groupBy("qid", "token").agg(F.count("*").alias("tf"))


def _cosine_sql(agg: str, idf: str, both: str, unseen: str, least: str, k: int) -> str:
    return f"""WITH {D}, {ASK_TF}, w AS (SELECT token, {idf} AS idf FROM post GROUP BY token),
d AS (SELECT id, token, tf / {agg}(tf) OVER (PARTITION BY id) {both} AS w FROM post JOIN w USING (token)),
q AS (SELECT qid, token, tf / {agg}(tf) OVER (PARTITION BY qid) * coalesce(idf, {unseen}) AS wq FROM atf LEFT JOIN w USING (token)),
nd AS (SELECT id, sqrt(sum(w * w)) AS nd FROM d GROUP BY id), nq AS (SELECT qid, sqrt(sum(wq * wq)) AS nq FROM q GROUP BY qid),
x AS (SELECT qid, id, sum(w * wq) AS dot FROM q JOIN d USING (token) GROUP BY ALL),
s AS (SELECT qid, id, round(dot / (nd * nq), 6) AS score FROM x JOIN nd USING (id) JOIN nq USING (qid) WHERE nd > 0 AND nq > 0),
r AS (SELECT *, {RANK} FROM s WHERE score >= {least}) SELECT qid, id, score, rank FROM r WHERE rank <= {k}"""


@C("top6_tfidf_search", _cosine_sql("max", "ln((SELECT count(*) FROM documents) / count(*))", "", "0.0", "0.1", 5))
def top6(spark, d):
    return S.cosine_top(read(spark, d, "documents"), asked_tf(spark, d), 5, 0.1, False)


@C("top7_recall", _cosine_sql("sum", "ln((SELECT count(*) FROM documents) / (count(*) + 1)) + 1", "* idf", "1.0", "0.15", 3))
def top7(spark, d):
    return S.cosine_top(read(spark, d, "documents"), asked_tf(spark, d), 3, 0.15, True)


TARGETS = r"tg AS (SELECT item_id AS qid, unnest(list_slice(list_filter(regexp_extract_all(lower(text), '[a-z]{5,}'), lambda x: true), 1, 3)) AS target FROM benchmark)"


def targets(spark, d):
    words = F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), 0), 1, 3)
    return read(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.explode(words).alias("target"))


def structural(spark, d, scored=None):
    """Names that hold a target, at most three targets a question: the names are all words of five letters
    or more of the whole texts. A question without a target gets its keyword scores instead."""
    docs = read(spark, d, "documents")
    named = docs.select(F.col("doc_id").alias("id"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), 0))).alias("name"))
    sought = targets(spark, d)
    return S.structural_scores(named, sought).unionByName((keyword(spark, d) if scored is None else scored).hint("merge").join(sought.select("qid").distinct(), "qid", "left_anti").select("qid", "id", "score"))


NAMED = r"nm AS (SELECT DISTINCT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS name FROM documents), np AS (SELECT name, target FROM (SELECT DISTINCT name FROM nm) JOIN (SELECT DISTINCT target FROM tg) ON contains(name, target)), st AS (SELECT DISTINCT qid, id, 1.0::DOUBLE AS score FROM tg JOIN np USING (target) JOIN nm USING (name) UNION ALL SELECT qid, id, score FROM kw WHERE qid NOT IN (SELECT qid FROM tg))"


@C("top4_structural_search", f"WITH {KEYWORD}, {TARGETS}, {NAMED}, r AS (SELECT *, {RANK} FROM st) SELECT qid, id, score, rank FROM r WHERE rank <= 5")
def top4(spark, d):
    return S.top_k(structural(spark, d), 5)


HYBRID = f"""{KEYWORD}, {JACCARD.split(f'{Q}, ')[1]}, {TARGETS}, {NAMED},
k1 AS (SELECT *, {RANK} FROM kw), k2 AS (SELECT *, {RANK} FROM jc), k3 AS (SELECT *, {RANK} FROM st),
u AS (SELECT qid, id, score * 0.3 AS score FROM k1 WHERE rank <= 10 UNION ALL SELECT qid, id, score * 0.5 FROM k2 WHERE rank <= 10 UNION ALL SELECT qid, id, score * 0.8 FROM k3 WHERE rank <= 5),
hy AS (SELECT qid, id, round(sum(score), 6) AS score FROM u GROUP BY ALL), hr AS (SELECT *, {RANK} FROM hy)"""


def hybrid(spark, d):
    common = written(met(spark, d), "met")
    return S.hybrid(keyword_of(common), jaccard_of(spark, d, common), structural(spark, d, keyword_of(common)), 5)


@C("top5_set1_hybrid_search", f"WITH {HYBRID} SELECT qid, id, score, rank FROM hr WHERE rank <= 5")
def top5(spark, d):
    return hybrid(spark, d)


@C("top12_context", f"WITH {HYBRID} SELECT qid, md5(string_agg('Source: ' || source || chr(10) || substring(text, 1, 500), chr(10) || chr(10) ORDER BY rank)) AS context FROM hr JOIN documents ON doc_id = id WHERE rank <= 3 GROUP BY qid")
def top12(spark, d):
    """The three best hits of each question as one text."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", F.substring("text", 1, 500).alias("snippet"))
    parts = hybrid(spark, d).filter("rank <= 3").hint("merge").join(docs, "id").withColumn("part", F.concat(F.lit("Source: "), "source", F.lit("\n"), "snippet"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "part"))), lambda x: x.part), "\n\n")
    return parts.groupBy("qid").agg(F.md5(joined).alias("context"))


@C("win17_source_mix", f"WITH {KEYWORD}, x AS (SELECT qid, id, score, lang = 'en' AS english, row_number() OVER (PARTITION BY qid, lang = 'en' ORDER BY score DESC, id) AS r FROM kw JOIN documents ON doc_id = id) SELECT qid, id, english FROM x WHERE r <= CASE WHEN english THEN 2 ELSE 3 END")
def win17(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("lang") == "en").alias("english"))
    best = V.last_n(keyword(spark, d).hint("merge").join(docs, "id"), ["qid", "english"], [F.desc("score"), F.col("id")], 3)  # limited in each task
    return best.filter(F.col("rank") <= F.when(F.col("english"), 2).otherwise(3)).select("qid", "id", "english")


IDX = r"ix AS (SELECT doc_id AS id, unnest(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+'), lambda x: regexp_matches(x, '^[a-z_][a-z0-9_]{2,}$'))) AS token FROM documents), ip AS (SELECT id, token, count(*) AS tf FROM ix GROUP BY ALL), qw AS (SELECT item_id AS qid, unnest(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+'), lambda x: regexp_matches(x, '^[a-z_][a-z0-9_]{2,}$'))) AS word FROM benchmark), vo AS (SELECT DISTINCT token FROM ip), pr AS (SELECT token, word, CASE WHEN token = word THEN 1.5 ELSE 0.5 END AS x FROM vo JOIN (SELECT DISTINCT word FROM qw) ON contains(token, word) OR contains(word, token))"


@C("jn2_substring_search", f"WITH {IDX}, s AS (SELECT qid, id, sum(x * tf)::DOUBLE AS score FROM qw JOIN pr USING (word) JOIN ip USING (token) GROUP BY ALL), r AS (SELECT *, {RANK} FROM s) SELECT qid, id, score, rank FROM r WHERE rank <= 5")
def jn2(spark, d):
    asked_words = F.explode(tokens.index_words(F.col("text")))  # as the index reads words; one asked twice counts twice
    words = read(spark, d, "benchmark").select(F.col("item_id").alias("qid"), asked_words.alias("token"))
    return S.substring_top(read(spark, d, "documents"), words, 5, tokens=tokens.index_words(F.col("text")))


@C("snk11_removed_documents", f"WITH {D} SELECT token, count(*) AS df FROM post WHERE id NOT IN (SELECT doc_id FROM labels) GROUP BY token")
def snk11(spark, d):
    gone = read(spark, d, "labels").select(F.col("doc_id").alias("id"))
    return S.without(posts(spark, d), gone).groupBy("token").agg(F.count("*").alias("df"))


@C("flt1_flt2_filtered", "SELECT doc_id, source FROM documents WHERE lang = 'en' AND contains(source, '1')")
def flt1(spark, d):
    mode = F.lit("en")
    rows = read(spark, d, "documents").filter((mode == "mixed") | (F.col("lang") == mode))
    return rows.filter(F.contains("source", F.lit("1"))).select("doc_id", "source")


@C("flt12_like", "SELECT doc_id, source FROM documents WHERE text ILIKE '%tion of%' OR source ILIKE '%SRC1' ORDER BY doc_id DESC LIMIT 20")
def flt12(spark, d):
    return read(spark, d, "documents").filter(F.col("text").ilike("%tion of%") | F.col("source").ilike("%SRC1")).orderBy(F.desc("doc_id")).limit(20).select("doc_id", "source")


@C("flt14_part_names", "WITH q AS (SELECT p_partkey AS qid, list_distinct(list_filter(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda w: length(w) >= 3)) AS ws FROM part WHERE p_partkey % 50 = 0), s AS (SELECT qid, p_partkey AS id, 2.0::DOUBLE AS score FROM q JOIN part ON len(list_filter(ws, lambda w: contains(lower(p_name), w))) > 0), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank FROM s) SELECT qid, id, score, rank FROM r WHERE rank <= 10")
def flt14(spark, d):
    """Parts whose name holds a word of an asked part's name. All hits score alike, so a word's ten smallest ids are enough."""
    part = read(spark, d, "part")
    runs = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0))
    words = part.filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("qid"), F.explode(F.filter(runs("p_name"), lambda w: F.length(w) >= 3)).alias("word"))
    named = part.select(F.col("p_partkey").alias("id"), F.explode(runs("p_name")).alias("token"))
    hit = S.first_holding(named, words.select("word").distinct(), 10)
    return S.top_k(words.hint("merge").join(hit, "word").select("qid", "id").distinct().withColumn("score", F.lit(2.0)), 10)


@C("set2_distinct", "SELECT lang, count(DISTINCT source) AS sources FROM documents GROUP BY lang")
def set2(spark, d):
    return read(spark, d, "documents").select("lang", "source").distinct().groupBy("lang").agg(F.count("*").alias("sources"))


@C("set4_overlap", "WITH a AS (SELECT doc_id, list_distinct(string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' ')) AS w FROM documents), b AS (SELECT doc_id, w, lag(w) OVER (ORDER BY doc_id) AS v FROM a) SELECT doc_id, len(list_intersect(w, v))::INT AS shared FROM b WHERE v IS NOT NULL")
def set4(spark, d):
    """Words shared with the document before, whatever its id."""
    words = F.array_distinct(tokens.blank_split(F.col("text")))
    return shared_with_before(read(spark, d, "documents"), "doc_id", "text", words).withColumnRenamed("id", "doc_id")


@C("set5_line_differences", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), a AS (SELECT doc_id, line, count(*) AS n FROM l GROUP BY ALL), o AS (SELECT doc_id + 1 AS doc_id, line, n FROM a WHERE doc_id % 2 = 0), w AS (SELECT * FROM a WHERE doc_id % 2 = 1), j AS (SELECT coalesce(w.doc_id, o.doc_id) AS doc_id, coalesce(w.n, 0) AS wn, coalesce(o.n, 0) AS nn FROM w FULL JOIN o ON w.doc_id = o.doc_id AND w.line = o.line) SELECT doc_id, sum(greatest(wn - nn, 0))::BIGINT AS added, sum(greatest(nn - wn, 0))::BIGINT AS removed FROM j GROUP BY doc_id")
def set5(spark, d):
    """Lines added and removed between versions, as multisets: an odd document is the next version of the one before."""
    n = read(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line")).groupBy("doc_id", "line").agg(F.count("*").alias("n"))
    old = (F.col("doc_id") % 2 == 0).cast("int")
    both = n.select((F.col("doc_id") + old).alias("doc_id"), "line", (F.col("n") * (1 - 2 * old)).alias("n")).groupBy("doc_id", "line").agg(F.sum("n").alias("n"))
    return both.groupBy("doc_id").agg(F.sum(F.greatest("n", F.lit(0))).alias("added"), F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("removed"))


@C("scl3_arrays", r"WITH w AS (SELECT doc_id, list_distinct(string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' ')) AS w FROM documents) SELECT doc_id, len(w)::INT AS n, array_to_string(list_slice(list_sort(w), 1, 5), ',') AS first, list_contains(w, 'the') AS has_the FROM w")
def scl3(spark, d):
    w = F.array_distinct(tokens.blank_split(F.col("text")))
    return read(spark, d, "documents").select("doc_id", w.alias("w")).select("doc_id", F.size("w").alias("n"), F.array_join(F.slice(F.array_sort("w"), 1, 5), ",").alias("first"), F.array_contains("w", "the").alias("has_the"))


@C("win2_line_chunks", r"WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), u AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l), g AS (SELECT doc_id, ((i - 1) // 5)::INT AS chunk, min(i)::INT AS start_line, max(i)::INT AS end_line, string_agg(line, chr(10) ORDER BY i) AS c FROM u GROUP BY ALL) SELECT doc_id, chunk, start_line, end_line, md5(c) AS h FROM g WHERE regexp_replace(c, '\s', '', 'g') <> ''")
def win2(spark, d):
    return V.line_chunks(read(spark, d, "documents"), 5).select("doc_id", "chunk", "start_line", "end_line", F.md5("content").alias("h"))


@C("win5_budget", f"WITH {KEYWORD}, x AS (SELECT qid, id, score, sum(n_chars) OVER (PARTITION BY qid ORDER BY score DESC, id) AS spent FROM kw JOIN documents ON doc_id = id) SELECT qid, id, spent::BIGINT AS spent FROM x WHERE spent <= 8000")
def win5(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    return V.within_budget(keyword(spark, d).hint("merge").join(docs, "id"), ["qid"], [F.desc("score"), F.col("id")], F.col("n_chars"), 8000, least=1, free=True).select("qid", "id", "spent")


@C("win6_filled", f"WITH {KEYWORD}, r AS (SELECT *, {RANK} FROM kw), x AS (SELECT qid, id, text, coalesce(sum(length(text)) OVER (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r JOIN documents ON doc_id = id WHERE rank <= 3) SELECT qid, id, md5(substring(text, 1, (2000 - before)::BIGINT)) AS h FROM x WHERE before < 2000")
def win6(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return V.filled(S.top_k(keyword(spark, d), 3).hint("merge").join(docs, "id"), ["qid"], [F.col("rank")], "text", 2000).select("qid", "id", F.md5("text").alias("h"))


@C("win9_first_lines", "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), u AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l), g AS (SELECT doc_id, line, min(i) AS i FROM u GROUP BY ALL) SELECT doc_id, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY i)) AS h FROM g GROUP BY doc_id")
def win9(spark, d):
    return V.first_lines(read(spark, d, "documents")).select("doc_id", "n_lines", F.md5("text").alias("h"))


@C("win14_byte_cap", "WITH x AS (SELECT doc_id, source, sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id DESC) AS s FROM documents) SELECT source, count(*) AS kept, min(doc_id) AS oldest FROM x WHERE s <= 20000 GROUP BY source")
def win14(spark, d):
    sizes = read(spark, d, "documents").select("source", "doc_id", F.octet_length("text").alias("n"))
    kept = V.within_budget(sizes, ["source"], [F.desc("doc_id")], F.col("n"), 20000, least=1, free=True)
    return kept.groupBy("source").agg(F.count("*").alias("kept"), F.min("doc_id").alias("oldest"))


@C("win18_whole_chunks", "SELECT 'kb_' || source || '_' || doc_id AS chunk_id, md5(substring(text, 1, 2000)) AS h FROM documents")
def win18(spark, d):
    return read(spark, d, "documents").select(F.concat_ws("_", F.lit("kb"), "source", "doc_id").alias("chunk_id"), F.md5(F.substring("text", 1, 2000)).alias("h"))


@C("top8_relevance", r"WITH k AS (SELECT doc_id, lower(text) AS t, list_distinct(list_concat(string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' '), ['func', 'var', 'signal', 'class', 'extends', 'if', 'for', 'while'])) AS ws FROM documents), p AS (SELECT a.doc_id, a.ws, b.t FROM k a JOIN k b ON b.doc_id = a.doc_id + 1) SELECT doc_id, round(least(1.0, len(list_filter(ws, lambda w: contains(t, w))) / len(ws) + CASE WHEN list_contains(ws, 'fix') AND contains(t, 'error') THEN 0.3 ELSE 0.0 END), 6) AS relevance FROM p")
def top8(spark, d):
    """Each document's words as a question to the next one."""
    terms = F.array(*map(F.lit, ["func", "var", "signal", "class", "extends", "if", "for", "while"]))
    docs = read(spark, d, "documents").select("doc_id", F.lower("text").alias("t"), F.array_distinct(F.concat(tokens.blank_split(F.col("text")), terms)).alias("ws"))
    pairs = docs.select("doc_id", "ws").hint("merge").join(docs.select((F.col("doc_id") - 1).alias("doc_id"), "t"), "doc_id")
    share = F.size(F.filter("ws", lambda w: F.contains("t", w))) / F.size("ws")
    boost = F.when(F.array_contains("ws", "fix") & F.contains("t", F.lit("error")), 0.3).otherwise(0.0)
    return pairs.select("doc_id", F.round(F.least(F.lit(1.0), share + boost), 6).alias("relevance"))


@C("top11_trimmed_lines", r"WITH q AS (SELECT item_id AS qid, list_distinct(string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' ')) AS ws FROM benchmark), l AS (SELECT doc_id AS qid, string_split(text, chr(10)) AS ls FROM documents), u AS (SELECT qid, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l), s AS (SELECT qid, line, i, len(list_intersect(list_distinct(string_split(trim(regexp_replace(lower(line), '\s+', ' ', 'g')), ' ')), ws)) AS score FROM u JOIN q USING (qid)), x AS (SELECT qid, i, sum(length(line) + 1) OVER (PARTITION BY qid ORDER BY score DESC, line DESC, i) AS spent FROM s) SELECT qid, i::INT AS line_no, spent::BIGINT AS spent FROM x WHERE spent <= 200")
def top11(spark, d):
    """Lines of the document with the question's id, by shared words, within 200 characters."""
    asked_words = read(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.array_distinct(tokens.blank_split(F.col("text"))).alias("ws"))
    lines = read(spark, d, "documents").select(F.col("doc_id").alias("qid"), F.posexplode(F.split("text", "\n", -1)).alias("p", "line"))
    scored = lines.hint("merge").join(asked_words, "qid").withColumn("score", F.size(F.array_intersect(F.array_distinct(tokens.blank_split(F.col("line"))), "ws")))
    return V.within_budget(scored, ["qid"], [F.desc("score"), F.desc("line"), F.col("p")], F.length("line") + 1, 200).select("qid", (F.col("p") + 1).alias("line_no"), F.col("spent").cast("long"))


@C("agg18_storage", "SELECT count(*) AS rows_, count(DISTINCT source) AS sources, sum(length(text))::BIGINT AS chars, round(sum(length(text)) / 1048576 / 200 * 100, 6) AS used FROM documents")
def agg18(spark, d):
    chars = F.sum(F.length("text"))
    return read(spark, d, "documents").agg(F.count("*").alias("rows_"), F.countDistinct("source").alias("sources"), chars.alias("chars"), F.round(chars / 1048576 / 200 * 100, 6).alias("used"))


@C("agg21_fingerprint", "WITH p AS (SELECT source || '_' || doc_id // 1000 AS project, source || '/' || doc_id || ':' || n_chars AS p FROM documents) SELECT project, substring(md5(string_agg(p, '|' ORDER BY p)), 1, 16) AS fingerprint, count(*) AS files FROM p GROUP BY project")
def agg21(spark, d):
    from ..operators.metrics import fingerprint

    project = F.concat_ws("_", "source", F.floor(F.col("doc_id") / 1000))  # a thousand files at most
    return fingerprint(read(spark, d, "documents").withColumn("project", project), "project", F.concat_ws("/", "source", "doc_id"), F.col("n_chars"))


@C("jn7_unlabelled", "SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)")
def jn7(spark, d):
    return read(spark, d, "documents").hint("merge").join(read(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@C("jn9_shared_keywords", "WITH k AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) > 9))) AS w FROM documents), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM k a JOIN k b ON a.w = b.w AND a.doc_id < b.doc_id GROUP BY ALL) SELECT a, max(shared) AS most FROM p WHERE shared >= 2 GROUP BY a")
def jn9(spark, d):
    """Documents that share two long words or more with a later one."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0), lambda x: F.length(x) > 9))
    return most_shared(read(spark, d, "documents").select(F.col("doc_id").alias("id"), words.alias("s")))


@C("jn12_changed", "WITH o AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '.' ELSE text END) AS h FROM documents WHERE doc_id % 5 <> 0) SELECT d.doc_id, o.h IS NULL AS is_new FROM documents d LEFT JOIN o USING (doc_id) WHERE o.h IS DISTINCT FROM sha256(text)")
def jn12(spark, d):
    """Documents whose hash isn't the stored one; the stored state is made from the table, changed in places."""
    docs = read(spark, d, "documents")
    old = docs.filter("doc_id % 5 != 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("h"))
    return docs.hint("merge").join(old, "doc_id", "left").filter(~F.sha2("text", 256).eqNullSafe(F.col("h"))).select("doc_id", F.col("h").isNull().alias("is_new"))


@C("jn13_str4_unseen", "WITH s AS (SELECT DISTINCT md5(text) AS h FROM documents WHERE doc_id % 3 = 0) SELECT min(doc_id) AS doc_id, md5(text) AS h FROM documents WHERE doc_id % 3 <> 0 AND md5(text) NOT IN (SELECT h FROM s) GROUP BY md5(text)")
def jn13(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.md5("text").alias("h"))
    seen = docs.filter("doc_id % 3 = 0").select("h").distinct()
    return docs.filter("doc_id % 3 != 0").hint("merge").join(seen, "h", "left_anti").groupBy("h").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "h")


@C("src10_src12_feed_entries", r"WITH e AS (SELECT source, doc_id, array_to_string(list_slice(string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' '), 1, 3), ' ') AS topic, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, md5(concat_ws(chr(10), 'Title: ' || substring(text, 1, 40), 'Summary: ' || substring(text, 1, 200), 'Link: ' || source || '/' || doc_id)) AS h FROM documents) SELECT source, doc_id, topic, h FROM e WHERE r <= 3")
def src10(spark, d):
    """Three entries of each source, shaped as title, summary and link."""
    topic = F.array_join(F.slice(tokens.blank_split(F.col("text")), 1, 3), " ")
    content = F.concat_ws("\n", F.concat(F.lit("Title: "), F.substring("text", 1, 40)), F.concat(F.lit("Summary: "), F.substring("text", 1, 200)), F.concat(F.lit("Link: "), "source", F.lit("/"), "doc_id"))
    rows = V.last_n(read(spark, d, "documents"), ["source"], [F.col("doc_id")], 3)
    return rows.select("source", "doc_id", topic.alias("topic"), F.md5(content).alias("h"))


WORDS = "SELECT doc_id, source, list_filter(list_transform(string_split(text, chr(10)), lambda x: array_to_string(regexp_extract_all(lower(x), '[a-z]+'), ' ')), lambda x: x <> '') AS ts FROM documents"


@C("src10_feeds", rf"WITH d AS ({WORDS}), e AS (SELECT doc_id, source, unnest(ts) AS title, generate_subscripts(ts, 1) - 1 AS place FROM d) SELECT doc_id AS feed_id, place, array_to_string(list_slice(string_split(title, ' '), 1, 3), ' ') AS topic, md5('Title: ' || title || chr(10) || 'Source: ' || source || chr(10) || 'URL: http://x.example/' || place || chr(10) || chr(10) || 'Summary: ' || length(title)) AS h FROM e WHERE place < 3")
def src10_feeds(spark, d):
    """Each document as a feed of its lines, in RSS or Atom, parsed again: three entries of each."""
    from ..sources import feeds

    titles = F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.array_join(F.regexp_extract_all(F.lower(x), F.lit("[a-z]+"), F.lit(0)), " ")), lambda x: x != "")
    rss = F.transform("ts", lambda x, i: F.concat(F.lit("<item><title>"), x, F.lit("</title><link>http://x.example/"), i, F.lit("</link><description>"), F.length(x), F.lit("</description></item>")))
    atom = F.transform("ts", lambda x, i: F.concat(F.lit('<entry><title>'), x, F.lit('</title><link rel="edit" href="no"/><link href="http://x.example/'), i, F.lit('"/><summary>'), F.length(x), F.lit("</summary></entry>")))
    head = F.concat(F.lit("<title>"), "source", F.lit("</title>"))
    xml = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('<rss version="2.0"><channel>'), head, F.array_join(rss, ""), F.lit("</channel></rss>"))).otherwise(F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), head, F.array_join(atom, ""), F.lit("</feed>")))
    landed = read(spark, d, "documents").select("doc_id", "source", titles.alias("ts")).select(F.col("doc_id").alias("feed_id"), xml.alias("xml"))
    return feeds.entries(landed).select("feed_id", "place", "topic", F.md5("content").alias("h"))
