"""Registered queries of the operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytebpe, decontam, langid, licences, linededup, merkle, sharding, simhash, spelling, substrings, tokencount, topk, urlfilter
from ._text import LOWER, UPPER, ascii_lower

SHARDS = 16
TOKEN_LIMIT = 2048
URL_RULES = [urlfilter.Rule("block", "net"), urlfilter.Rule("allow", "example.net", "/en/"), urlfilter.Rule("block", "example.com", "/de/"), urlfilter.Rule("allow", "org", "/fr/")]
MANIFEST_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.bounded_ring(_read(spark, sf_dir, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"), size=4, k=4)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.drop_repeated_lines(_read(spark, sf_dir, "documents"), min_chars=10, min_docs=2)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokencount.count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bytebpe.round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    n = (F.octet_length("packed") / 4).cast("long")
    return out.select("doc_id", n.alias("n_tokens"), F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.repeats(_read(spark, sf_dir, "documents"), length=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_read(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    out = langid.predict(docs, langid.fit(docs))
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return urlfilter.judge(pages, URL_RULES, urlfilter.fit(urlfilter.labelled_by_rules(pages, URL_RULES)))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    lowered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, ascii_lower(F.col("text")))  # as checked later: some texts have changed
    out = merkle.manifest(docs, MANIFEST_FIELDS, lowered)
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_decontamination": op2_decontamination,
    "op3_simhash": op3_simhash,
    "op4_line_dedup": op4_line_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_top_k": op7_top_k,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_language_id": op10_language_id,
    "op11_url_filter": op11_url_filter,
    "op12_merkle": op12_merkle,
    "op13_spelling": op13_spelling,
}

# crc32 of a text's UTF-8 bytes, as a table of 256 entries and a fold
CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i))"
BYTES = "list_transform(range(1, octet_length(encode({0})) + 1), lambda i: 16 * (instr('0123456789ABCDEF', substr(hex(encode({0})), 2 * i - 1, 1)) - 1) + instr('0123456789ABCDEF', substr(hex(encode({0})), 2 * i, 1)) - 1)"
CRC = "xor(list_reduce({0}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"
TO_LOWER = f"translate({{0}}, '{UPPER}', '{LOWER}')"
FIELD = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"
LEAF = "sha256(" + " || ".join(FIELD.format(f) for f in MANIFEST_FIELDS[:-1])

# fmt: off
ORACLES: dict[str, str] = {
    "op4_line_dedup": r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND k.doc_id <> r.keeper AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op7_top_k": r"""
WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op8_substring_dedup": r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ 	-
]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS p, w FROM d WHERE len(w) >= 35),
h AS (SELECT doc_id, p, md5(array_to_string(list_slice(w, p, p + 34), ' ')) AS h FROM s),
r AS (SELECT doc_id, p FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS i FROM r),
g AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS kept FROM x ANTI JOIN c ON x.doc_id = c.doc_id AND x.i = c.i GROUP BY x.doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id LEFT JOIN k ON d.doc_id = k.doc_id""",
    "op9_license_scan": rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(list_transform(list_zip(w[1:len(w) - 1], w[2:]), lambda z: z[1] || ' ' || z[2])) AS gram, unnest(range(0, len(w) - 1)) AS pos FROM d WHERE len(w) > 1
  UNION ALL SELECT doc_id, unnest(list_transform(list_zip(w[1:len(w) - 4], w[2:len(w) - 3], w[3:len(w) - 2], w[4:len(w) - 1], w[5:]), lambda z: concat_ws(' ', z[1], z[2], z[3], z[4], z[5]))),
  unnest(range(0, len(w) - 4)) FROM d WHERE len(w) > 4),
v(tid, kind, label, k, drift, text) AS (VALUES {licences.template_values(2, 5, 3)}),
u AS (SELECT *, string_split(text, ' ') AS tw, unnest(range(0, len(string_split(text, ' ')) - k + 1)) AS tpos FROM v),
t AS (SELECT tid, kind, label, len(tw) - k + 1 AS grams, drift, tpos, array_to_string(tw[tpos + 1:tpos + k], ' ') AS gram FROM u),
a AS (SELECT doc_id, tid, kind, label, grams, drift, pos - tpos AS diag, list(DISTINCT tpos) AS tps FROM g JOIN t USING (gram) GROUP BY ALL),
b AS (SELECT *, CASE WHEN diag - lag(diag) OVER l <= drift THEN 0 ELSE 1 END AS new FROM a WHERE kind = 'phrase' OR len(tps) > 1 WINDOW l AS (PARTITION BY doc_id, tid ORDER BY diag)),
s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, tid ORDER BY diag) AS span FROM b),
m AS (SELECT doc_id, kind, label, len(list_distinct(flatten(list(tps)))) / grams AS cover, count(*) FILTER (len(tps) = grams) AS places,
  min(diag) FILTER (len(tps) = grams) AS first, max(diag) FILTER (len(tps) = grams) AS last, min(diag) AS start FROM s GROUP BY doc_id, tid, kind, label, grams, span),
o AS (SELECT *, max(cover) OVER (PARTITION BY doc_id, kind ORDER BY start RANGE BETWEEN 40 PRECEDING AND 40 FOLLOWING) AS best FROM m WHERE places > 0 OR cover >= 0.6),
n AS (SELECT *, kind = 'phrase' AND places > 0 AS base, (kind = 'phrase' AND places > 0) OR (kind <> 'phrase' AND cover >= 0.6) AS named FROM o WHERE kind = 'phrase' OR cover = best),
f AS (SELECT doc_id, sum(places) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(last) FILTER (base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (named) AS labels, max(least(cover, 1.0)) FILTER (named) AS score FROM n GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN f USING (doc_id)""",
    "op12_merkle": rf"""
WITH RECURSIVE crc AS (SELECT {CRC_TABLE} AS t),
l AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS g, {LEAF} || {FIELD.format("text")}) AS leaf, CASE WHEN {CRC.format(BYTES.format("doc_id::VARCHAR"))} % 3 = 0
  THEN {LEAF} || {FIELD.format(TO_LOWER.format("text"))}) END AS changed FROM documents, crc),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos FROM l),
a(g, lvl, pos, n, h) AS (SELECT g, 0, pos, count(*) OVER (PARTITION BY g), leaf FROM o
  UNION ALL SELECT g, lvl + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM a WHERE n > 1 GROUP BY g, lvl, pos // 8, n),
s AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS gpos FROM a WHERE n = 1),
b(lvl, pos, n, h) AS (SELECT 0, gpos, count(*) OVER (), subroot FROM s
  UNION ALL SELECT lvl + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM b WHERE n > 1 GROUP BY lvl, pos // 8, n),
top AS (SELECT max(lvl) AS lvl FROM b), high AS (SELECT g, max(lvl) AS lvl FROM a GROUP BY g),
w AS (SELECT o.r, x.lvl, x.pos, x.h, o.pos // (8 ** x.lvl)::BIGINT AS me FROM o JOIN high ON o.g = high.g JOIN a x ON x.g = o.g AND x.lvl < high.lvl AND x.pos // 8 = o.pos // (8 ** (x.lvl + 1))::BIGINT
  UNION ALL SELECT o.r, high.lvl + x.lvl, x.pos, x.h, s.gpos // (8 ** x.lvl)::BIGINT FROM o JOIN s ON o.g = s.g JOIN high ON o.g = high.g JOIN b x ON x.n > 1 AND x.pos // 8 = s.gpos // (8 ** (x.lvl + 1))::BIGINT),
v AS (SELECT r, lvl, coalesce(string_agg(h, '' ORDER BY pos) FILTER (pos < me), '') AS bef, coalesce(string_agg(h, '' ORDER BY pos) FILTER (pos > me), '') AS aft FROM w GROUP BY r, lvl),
p AS (SELECT r, sha256(string_agg(bef || aft, '' ORDER BY lvl)) AS proof FROM v GROUP BY r),
f(r, lvl, h) AS (SELECT r, 0, coalesce(changed, leaf) FROM o UNION ALL SELECT f.r, f.lvl + 1, sha256(bef || f.h || aft) FROM f JOIN v ON v.r = f.r AND v.lvl = f.lvl),
e AS (SELECT r, arg_max(h, lvl) AS folded FROM f GROUP BY r)
SELECT o.doc_id, o.leaf, s.subroot, b.h AS root, coalesce(p.proof, sha256('')) AS proof_sha256, e.folded AS folded_root, e.folded = b.h AS verified
FROM o JOIN s ON o.g = s.g JOIN e ON e.r = o.r LEFT JOIN p ON p.r = o.r JOIN b ON b.n = 1""",
    "op13_spelling": rf"""
WITH RECURSIVE crc AS (SELECT {CRC_TABLE} AS t),
u AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all({TO_LOWER.format("text")}, '[a-zÀ-ÿ]+')) AS run FROM documents),
k AS (SELECT d || ':' || run AS key, run, count(*) AS times FROM u WHERE length(run) >= 6 GROUP BY ALL),
h AS (SELECT run, times, {CRC.format(BYTES.format("key"))} AS h FROM k, crc),
x AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM h),
w AS (SELECT word, sum(times)::BIGINT AS n FROM x WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
c AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
m AS (SELECT word, n, i, substr(word, 1, i - 1) AS bef, substr(word, i + 1) AS aft FROM c),
e AS (SELECT a.word, b.word AS other FROM m a JOIN m b ON a.i = b.i AND a.bef = b.bef AND a.aft = b.aft AND a.word <> b.word
  UNION SELECT m.word, w.word FROM m JOIN w ON w.word = m.bef || m.aft
  UNION SELECT w.word, m.word FROM m JOIN w ON w.word = m.bef || m.aft),
f AS (SELECT e.word, count(*) AS n_near, min(struct_pack(a := -o.n, b := encode(e.other), c := e.other)) AS best FROM e JOIN w o ON o.word = e.other GROUP BY e.word),
g AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.a >= 5 * w.n THEN best.c END AS form, CASE WHEN -best.a >= 5 * w.n THEN -best.a END AS form_n FROM w LEFT JOIN f ON f.word = w.word),
r(word, root, lvl) AS (SELECT word, word, 0 FROM g UNION ALL SELECT r.word, g.form, lvl + 1 FROM r JOIN g ON g.word = r.root WHERE g.form IS NOT NULL)
SELECT g.word, form, z.root, n, n_near, form_n::BIGINT AS form_n FROM g JOIN (SELECT word, arg_max(root, lvl) AS root FROM r GROUP BY word) z ON z.word = g.word""",
}
# fmt: on
