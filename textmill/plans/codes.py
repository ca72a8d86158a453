"""Queries of script and scene operators. Scripts and scenes are made from the documents: each line of
a text becomes a line of code, of a kind that follows from its length and place."""

from __future__ import annotations

from pyspark.sql.window import Window as W

from ..functions import lint
from ..operators import code as K
from ..operators import graphs as G
from ..operators import windows as V
from ..sources import readers
from ._base import Catalog, F, quoted, read

C = Catalog()

CODE = [
    "concat('extends \"res://', source, '/base.gd\"')",
    "concat('func ', w, '(a):')",
    "concat('\t', 'var ', w, ' = get_node(\"/root/', w, '\")')",
    "concat('signal ', w)",
    "concat('# ', w, ' TODO')",
    "concat('\t', 'for i in range(12):')",
    "concat('\t\t', 'print(', w, ')')",
    "concat('func _process(delta):')",
    "concat('var ', w, ' = preload(\"res://', source, '/', w, '.gd\")')",
    "''",
    "concat('\t', 'if ', w, ' != null:')",
    "concat('\t', w, '.velocity = ', w, '.health')",
]
SCENE = [
    "concat('[gd_scene load_steps=2]')",
    "concat('[ext_resource type=\"Script\" path=\"res://', source, '/', w, '.gd\" id=\"', i, '\"]')",
    "concat('[node name=\"', w, '\" type=\"Node2D\" parent=\".\"]')",
    "concat('[node name=\"', w, '\" type=\"Sprite\"]')",
    "concat('script = ExtResource(\"', i - 1, '\")')",
    "concat('position = ', length(line))",
    "concat('[connection signal=\"hit\" from=\"', w, '\" to=\".\" method=\"_on_', w, '\"]')",
    "concat('texture = Null(missing)')",
]


def _made_sql(name: str, forms: list[str], ext: str) -> str:
    case = " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(forms)).replace("'\t'", "chr(9)").replace("'\t\t'", "chr(9) || chr(9)")
    return (
        "l0 AS (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents), "
        "l1 AS (SELECT doc_id, source, unnest(ls) AS line, generate_subscripts(ls, 1)::INT AS i FROM l0), "
        "l2 AS (SELECT *, CASE WHEN regexp_extract(lower(line), '[a-z]+') = '' THEN 'x' ELSE regexp_extract(lower(line), '[a-z]+') END AS w FROM l1), "
        f"{name} AS (SELECT source || '/' || doc_id || '.{ext}' AS path, i AS line_no, CASE (length(line) + i) % {len(forms)} {case} END AS line FROM l2)"
    )


LINES = _made_sql("c", CODE, "gd")
FILES = LINES + ", f AS (SELECT path, string_agg(line, chr(10) ORDER BY line_no) AS content FROM c GROUP BY path)"
SCENES = _made_sql("c", SCENE, "tscn")


def _made(spark, d, forms, ext):
    rows = read(spark, d, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("p", "line"))
    word = F.regexp_extract(F.lower("line"), "[a-z]+", 0)
    rows = rows.withColumn("i", F.col("p") + 1).withColumn("w", F.when(word == "", "x").otherwise(word))
    case = " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(forms))
    return rows.select(F.concat("source", F.lit("/"), "doc_id", F.lit(f".{ext}")).alias("path"), F.col("i").alias("line_no"), F.expr(f"CASE (length(line) + i) % {len(forms)} {case} END").alias("line"))


def lines(spark, d):
    return _made(spark, d, CODE, "gd")


def files(spark, d):
    return K.files_of(lines(spark, d))


def scenes(spark, d):
    return K.scene_rows(_made(spark, d, SCENE, "tscn"))


def _file_columns(name, spark_columns, sql):
    @C(name, f"WITH {FILES} SELECT path, {sql} FROM f")
    def query(spark, d):
        return files(spark, d).select("path", *[c.alias(n) for n, c in spark_columns().items()])


def content():
    return F.col("content")


@C("src3_files", f"WITH {FILES} SELECT path, length(content)::INT AS size, md5(content) AS h FROM f WHERE length(content) <= 200000")
def src3(spark, d):
    return files(spark, d).filter(F.length("content") <= 200000).select("path", F.length("content").alias("size"), F.md5("content").alias("h"))


@C("flt5_types", "WITH p AS (SELECT doc_id, list_extract(['gd', 'tscn', 'tres', 'shader', 'md', 'png'], (doc_id % 6 + 1)::INT) AS ext FROM documents) SELECT doc_id, CASE WHEN ext IN ('gd', 'cs') THEN 'script' WHEN ext = 'tscn' THEN 'scene' WHEN ext = 'tres' THEN 'resource' WHEN ext IN ('shader', 'gdshader') THEN 'shader' WHEN ext IN ('md', 'txt') THEN 'text' ELSE 'other' END AS kind FROM p")
def flt5(spark, d):
    ext = F.element_at(F.array(*map(F.lit, ["gd", "tscn", "tres", "shader", "md", "png"])), (F.col("doc_id") % 6 + 1).cast("int"))
    return read(spark, d, "documents").select("doc_id", readers.kind(ext).alias("kind"))


FOLDERS = ["scripts/", ".git/", "a/.godot/", "addons/x/", "my_imports/", "a.git/"]


@C("flt4_pruned", "WITH p AS (SELECT source, list_extract([" + ", ".join(map(quoted, FOLDERS)) + "], (doc_id % 6 + 1)::INT) || source || '/' || doc_id || '.gd' AS path FROM documents) SELECT source, count(*) AS n FROM p WHERE NOT contains(path, '.godot') AND NOT contains(path, 'imports') AND NOT regexp_matches(path, '(^|/)(\\.git|\\.godot|addons)/') GROUP BY source")
def flt4(spark, d):
    """Files of folders that a project's scan leaves out, over paths made from each document's source."""
    folder = F.element_at(F.array(*map(F.lit, FOLDERS)), (F.col("doc_id") % 6 + 1).cast("int"))
    paths = read(spark, d, "documents").select("source", F.concat(folder, "source", F.lit("/"), "doc_id", F.lit(".gd")).alias("path"))
    return paths.filter(~readers.pruned(F.col("path"))).groupBy("source").agg(F.count("*").alias("n"))


_file_columns("lnt1_rules", lambda: {"issues": F.array_join(lint.findings(content(), lint.ISSUES), "; "), "improvements": F.array_join(lint.findings(content(), lint.IMPROVEMENTS), "; ")},
              "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(content, {quoted(p)}) THEN {quoted(x)} END" for p, x in lint.ISSUES) + "], lambda x: x IS NOT NULL), '; ') AS issues, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(content, {quoted(p)}) THEN {quoted(x)} END" for p, x in lint.IMPROVEMENTS) + "], lambda x: x IS NOT NULL), '; ') AS improvements")
_file_columns("lnt2_metadata", lambda: {"extends": F.regexp_extract(content(), r'(?m)^extends "?([^"\n]+)', 1), "functions": F.array_join(lint.functions(content()), ","), "tags": F.array_join(lint.tags(content()), ",")},
              r"""regexp_extract(content, '(?m)^extends "?([^"\n]+)', 1) AS extends, array_to_string(list_slice(regexp_extract_all(content, '(?m)^\s*func\s+(\w+)\s*\(', 1), 1, 20), ',') AS functions, array_to_string(list_filter([""" + ", ".join("CASE WHEN " + " OR ".join(f"contains(content, {quoted(w)})" for w in ws) + f" THEN '{t}' END" for t, ws in lint.TAGS.items()) + "], lambda x: x IS NOT NULL), ',') AS tags")  # fmt: skip
_file_columns("lnt3_large_files", lambda: {"n_lines": F.size(F.split(content(), "\n", -1)), "large": F.size(F.split(content(), "\n", -1)) > 500}, "len(string_split(content, chr(10)))::INT AS n_lines, len(string_split(content, chr(10))) > 500 AS large")
N = lambda p: f"len(regexp_extract_all(content, {quoted(p)}))"
COMPLEX = f"greatest(0, {N(r'(?m)^[^\S\n]*func\s+\w+')} * 2 + {N(r'(?m)^\s*(if|elif|else|for|while|match)\b')} - {N(r'(?m)^\s*signal\s+')} * 3 - {N('@(?:export|onready)')})"
_file_columns("lnt6_complexity", lambda: {"complexity": lint.complexity(content()).cast("int")}, f"({COMPLEX})::INT AS complexity")
_file_columns("lnt5_documentation", lambda: {"poor": lint.poorly_documented(content())},
              f"({N(r'(?m)^\s*#')} < len(string_split(content, chr(10))) / 50 OR ({N(r'(?m)^\s*func\s+\w+')} > 5 AND {N('\"\"\"[\\s\\S]*?\"\"\"')} = 0)) AND {N(r'(?m)^\s*func\s+\w+')} > 3 AS poor")
QUICK = r"""list_concat(list_filter([CASE WHEN len(string_split(content, chr(10))) > 50 THEN 'File too long' END, CASE WHEN (length(content) - length(replace(content, 'for ', ''))) / 4 > 2 THEN 'Too many loops' END, CASE WHEN contains(content, 'print(') THEN 'Debug prints left' END], lambda x: x IS NOT NULL), CASE WHEN true THEN list_transform(list_filter(v, lambda x: (length(content) - length(replace(content, x, ''))) / length(x) = 1), lambda x: 'Unused var: ' || x) END)"""


@C("lnt7_quick_issues", rf"WITH {FILES}, d0 AS (SELECT path, content, regexp_extract_all(content, 'var (\w+)', 1) AS r FROM f), v AS (SELECT path, content, list_filter(r, lambda x, i: list_position(r, x) = i) AS v FROM d0) SELECT path, array_to_string(list_slice({QUICK}, 1, 2), '; ') AS issues FROM v")
def lnt7(spark, d):
    return files(spark, d).select("path", F.array_join(lint.quick_issues(content()), "; ").alias("issues"))


_file_columns("lnt10_banned", lambda: {"reason": lint.banned(content())}, "CASE WHEN length(content) = 0 THEN 'Empty code' " + " ".join(f"WHEN contains(content, {quoted(p)}) THEN {quoted(r)}" for p, r in lint.BANNED) + " ELSE 'OK' END AS reason")
_file_columns("lnt11_loop_safety", lambda: {"issues": F.array_join(lint.loop_safety(content()), "; ")}, r"array_to_string(list_filter([CASE WHEN regexp_matches(content, '(?i)while\s+true\s*:') AND NOT contains(content, 'break') THEN 'Potential infinite loop detected' END, " + ", ".join(f"CASE WHEN contains(content, '{x}') THEN 'Dangerous function call: {x}' END" for x in ("OS.execute", "File.open", "Directory.open")) + "], lambda x: x IS NOT NULL), '; ') AS issues")
_file_columns("lnt19_line_numbers", lambda: {"line_no": F.coalesce(F.nullif(F.array_position(F.transform(F.split(content(), "\n", -1), lambda x: F.contains(x, F.lit("print("))), True), F.lit(0)), F.lit(-1)).cast("int")},
              "coalesce(nullif(list_position(list_transform(string_split(content, chr(10)), lambda x: contains(x, 'print(')), true), 0), -1)::INT AS line_no")
PATHS = ["data/", "data/../", "data/a/../", "data/../../", "/data/", "data/x..y/"]


@C("grd7_safe_paths", r"WITH p AS (SELECT doc_id, list_extract([" + ", ".join(map(quoted, PATHS)) + r"], (doc_id % 6 + 1)::INT) || source || '/' || doc_id AS path FROM documents) SELECT doc_id, NOT starts_with(path, '/') AND NOT regexp_matches(path, '(^|/)\.\.(/|$)') AS safe FROM p")
def grd7(spark, d):
    """Paths made from each document's source, some of which leave their root."""
    start = F.element_at(F.array(*map(F.lit, PATHS)), (F.col("doc_id") % 6 + 1).cast("int"))
    paths = read(spark, d, "documents").select("doc_id", F.concat(start, "source", F.lit("/"), "doc_id").alias("path"))
    return paths.select("doc_id", readers.safe_path(F.col("path")).alias("safe"))


HEAD = r"regexp_matches(line, '^(class|func)\s')"


@C("win1_chunks", f"WITH {LINES}, x AS (SELECT *, sum({HEAD}::INT) OVER (PARTITION BY path ORDER BY line_no) AS chunk FROM c) SELECT path, chunk::BIGINT AS chunk, min(line_no)::INT AS start_line, max(line_no)::INT AS end_line, max(CASE WHEN {HEAD} THEN regexp_extract(line, '^(class|func)\\s+([A-Za-z_]\\w*)', 1) END) AS kind, max(CASE WHEN {HEAD} THEN regexp_extract(line, '^(class|func)\\s+([A-Za-z_]\\w*)', 2) END) AS name FROM x GROUP BY path, chunk HAVING bool_or(regexp_replace(line, '\\s', '', 'g') <> '')")
def win1(spark, d):
    return K.chunks(lines(spark, d))


TYPE = "CASE WHEN ltrim(line, ' ') = '' OR ltrim(line, ' ') LIKE '#%' THEN NULL WHEN ltrim(line, ' ') LIKE 'class %' THEN 'class' WHEN ltrim(line, ' ') LIKE 'func %' THEN 'function' WHEN ltrim(line, ' ') LIKE 'signal %' THEN 'signal' WHEN ltrim(line, ' ') LIKE 'var %' OR ltrim(line, ' ') LIKE 'const %' THEN 'variable' END"


@C("win3_blocks", f"WITH {LINES}, t AS (SELECT *, {TYPE} AS t FROM c), b AS (SELECT *, last_value(t IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM t), x AS (SELECT *, sum(CASE WHEN t IS NOT NULL AND p IS NOT NULL AND t <> p THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_no) AS block FROM b) SELECT path, block::BIGINT AS block, min(line_no)::INT AS start_line, max(line_no)::INT AS end_line, max(t) AS kind FROM x GROUP BY path, block")
def win3(spark, d):
    return K.blocks(lines(spark, d))


BODIES = r"WITH {L}, e AS (SELECT *, regexp_matches(line, '^\s*func\s+_process\s*\(') AS head, regexp_matches(line, '^\s*func\s+\w+') OR regexp_matches(line, '^[^ \t\s]') AS edge FROM c), s AS (SELECT *, sum(edge::INT) OVER (PARTITION BY path ORDER BY line_no) AS span FROM e), g AS (SELECT path, span, bool_or(head) AS p, min(line_no)::INT AS line_number, sum((NOT edge AND NOT regexp_matches(line, '^\s*(#|$)'))::INT)::BIGINT AS body_lines FROM s GROUP BY ALL) SELECT path, line_number, body_lines FROM g WHERE p AND body_lines > 1".replace("{L}", LINES)


@C("win10_process_bodies", BODIES)
def win10(spark, d):
    return K.process_bodies(lines(spark, d), 1)


DEPS = r"""e AS (SELECT path AS src, regexp_extract(line, '^extends "res://([^"]+)"', 1) AS dst, 'extends' AS kind FROM c WHERE regexp_matches(line, '^extends "res://([^"]+)"') UNION SELECT path, regexp_extract(line, 'preload\("res://([^"]+)"\)', 1), 'preload' FROM c WHERE regexp_matches(line, 'preload\("res://([^"]+)"\)'))"""


@C("grf1_grf9_edges", f"WITH {LINES}, {DEPS} SELECT src, dst, kind FROM e")
def grf1(spark, d):
    return K.dependencies(lines(spark, d))


@C("snk1_adjacency", f"WITH {LINES}, {DEPS} SELECT src, string_agg(DISTINCT dst, ',' ORDER BY dst) AS dependencies FROM e GROUP BY src")
def snk1(spark, d):
    return K.dependencies(lines(spark, d)).groupBy("src").agg(F.array_join(F.sort_array(F.collect_set("dst")), ",").alias("dependencies"))


@C("jn4_attachments", f"WITH {LINES}, {DEPS} SELECT dst, count(DISTINCT src) AS users FROM e GROUP BY dst")
def jn4(spark, d):
    return K.dependencies(lines(spark, d)).groupBy("dst").agg(F.countDistinct("src").alias("users"))


LINKS = "e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem)"


def edges(spark, d):
    """part -> supplier links of all of lineitem, as links between numbers: a number that is both leads on."""
    return read(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()


CLOSE = f"RECURSIVE {LINKS}, s AS (SELECT DISTINCT dst AS start FROM e WHERE dst % 50 = 0), r AS (SELECT start, e.src AS node FROM s JOIN e ON e.dst = s.start UNION SELECT r.start, e.src FROM r JOIN e ON e.dst = r.node)"


@C("grf3_impact", f"WITH {CLOSE}, n AS (SELECT start, count(*) AS dependents FROM r GROUP BY start), k AS (SELECT dst AS start, count(DISTINCT src) AS direct FROM e GROUP BY dst) SELECT s.start, coalesce(dependents, 0) AS dependents, coalesce(direct, 0) AS direct, CASE WHEN coalesce(dependents, 0) > 5 THEN 'HIGH' WHEN coalesce(dependents, 0) > 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM s LEFT JOIN n USING (start) LEFT JOIN k USING (start)")
def grf3(spark, d):
    """The questions are the numbers divisible by 50, against all links."""
    e = edges(spark, d)
    return G.impact(e, e.filter("dst % 50 = 0").select(F.col("dst").alias("node")).distinct())


CIRCLES = f"RECURSIVE {LINKS}, r AS (SELECT src AS start, dst AS node FROM e UNION SELECT r.start, e.dst FROM r JOIN e ON e.src = r.node), m AS (SELECT a.start AS node, min(a.node) AS root FROM r a JOIN r b ON b.start = a.node AND b.node = a.start GROUP BY a.start)"


@C("grf4_cycles", f"WITH {CIRCLES} SELECT node FROM m")
def grf4(spark, d):
    """Numbers that lead back to themselves: members of strongly connected components."""
    return G.cyclic(edges(spark, d))


@C("grf4_components", f"WITH {CIRCLES} SELECT root, count(*) AS size FROM m GROUP BY root HAVING count(*) > 1")
def grf4_components(spark, d):
    """Each component of two numbers or more, by its smallest member."""
    members = G.strong_components(edges(spark, d))
    return members.groupBy(F.col("root").alias("r")).agg(F.min("node").alias("root"), F.count("*").alias("size")).drop("r")


@C("agg14_most_depended_on", "WITH e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem) SELECT dst, count(*) AS dependents FROM e GROUP BY dst ORDER BY dependents DESC, dst LIMIT 5")
def agg14(spark, d):
    return G.most_depended_on(read(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")))


@C("agg14_graph_stats", rf"WITH RECURSIVE {LINES}, {DEPS}, g AS (SELECT DISTINCT src, dst FROM e), q AS (SELECT path FROM c UNION SELECT dst FROM g UNION SELECT source || '/' || doc_id || '.tscn' FROM documents), r AS (SELECT src AS start, dst AS node FROM g UNION SELECT r.start, g.dst FROM r JOIN g ON g.src = r.node), m AS (SELECT a.start, min(a.node) AS root FROM r a JOIN r b ON b.start = a.node AND b.node = a.start GROUP BY a.start), t AS (SELECT dst, count(*) AS n FROM g GROUP BY dst ORDER BY n DESC, dst LIMIT 5) SELECT (SELECT count(*) FROM q) AS files, (SELECT count(*) FROM q WHERE path LIKE '%.gd') AS scripts, (SELECT count(*) FROM q WHERE path LIKE '%.tscn') AS scenes, (SELECT count(*) FROM g) AS edges, (SELECT count(DISTINCT root) FROM m) AS cycles, (SELECT string_agg(dst || ':' || n, ',' ORDER BY n DESC, dst) FROM t) AS top")
def agg14_stats(spark, d):
    """Files, scripts, scenes, edges, circles and the five most depended on of all scripts and scenes."""
    code = lines(spark, d)
    e = K.dependencies(code).select("src", "dst").distinct()
    scenes_ = read(spark, d, "documents").select(F.concat("source", F.lit("/"), "doc_id", F.lit(".tscn")).alias("path"))
    names = code.select("path").unionByName(e.select(F.col("dst").alias("path"))).unionByName(scenes_)
    top = F.array_join(F.transform("most_depended_on", lambda x: F.concat_ws(":", x["path"], x["dependents"])), ",")
    return G.stats(names, e).withColumn("top", top).drop("most_depended_on")


HEADS = r"sc AS (SELECT *, last_value(CASE WHEN line LIKE '[%' THEN line_no END IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS owner, CASE WHEN line LIKE '[%' THEN regexp_extract(line, '^\[(\w+)', 1) END AS section FROM c)"


@C("grf5_scene_rows", rf"WITH {SCENES}, {HEADS} SELECT path, line_no, section, owner::INT AS owner, CASE WHEN section IS NOT NULL THEN nullif(regexp_extract(line, '\bname=.([^\x22]*)\x22', 1), '') END AS a_name, CASE WHEN line NOT LIKE '[%' AND contains(line, ' = ') THEN regexp_extract(line, '^(\S+) = ', 1) END AS key FROM sc")
def grf5(spark, d):
    return scenes(spark, d).select("path", "line_no", "section", "owner", "a_name", "key")


@C("agg15_grf7_scene_stats", rf"WITH {SCENES}, {HEADS} SELECT path, count(*) FILTER (section = 'node') AS nodes, count(*) FILTER (section = 'ext_resource') AS resources, count(*) FILTER (section = 'connection') AS connections FROM sc GROUP BY path ORDER BY nodes DESC, path LIMIT 5")
def agg15(spark, d):
    n = lambda s: F.count_if(F.col("section") == s)
    return scenes(spark, d).groupBy("path").agg(n("node").alias("nodes"), n("ext_resource").alias("resources"), n("connection").alias("connections")).orderBy(F.desc("nodes"), "path").limit(5)


@C("win13_orphans", rf"WITH {SCENES}, {HEADS}, n AS (SELECT path, line_no, row_number() OVER (PARTITION BY path ORDER BY line_no) AS r FROM sc WHERE section = 'node' AND NOT contains(line, 'parent=')) SELECT path, line_no FROM n WHERE r > 1")
def win13(spark, d):
    nodes = scenes(spark, d).filter("section = 'node' AND a_parent IS NULL")
    return nodes.withColumn("r", F.row_number().over(W.partitionBy("path").orderBy("line_no"))).filter("r > 1").select("path", "line_no")


@C("jn6_bindings", rf"WITH {SCENES}, {HEADS}, x AS (SELECT path, regexp_extract(line, ' id=.([^\x22]*)\x22', 1) AS id, regexp_extract(line, 'path=.([^\x22]*)\x22', 1) AS res FROM sc WHERE section = 'ext_resource'), u AS (SELECT path, line_no, regexp_extract(line, 'ExtResource\(.([^\x22]*)\x22', 1) AS id FROM c WHERE line LIKE 'script = %') SELECT u.path, u.line_no, x.res FROM u LEFT JOIN x ON u.path = x.path AND u.id = x.id")
def jn6(spark, d):
    """Scripts of nodes by the resource id; null where the scene has no such resource."""
    s = scenes(spark, d)
    res = s.filter("section = 'ext_resource'").select("path", F.col("a_id").alias("id"), F.col("a_path").alias("res"))
    used = s.filter("key = 'script'").select("path", "line_no", F.regexp_extract("value", r'ExtResource\("([^"]*)"', 1).alias("id"))
    return used.hint("merge").join(res, ["path", "id"], "left").select("path", "line_no", "res")


@C("jn8_connections", rf"WITH {SCENES}, {HEADS}, n AS (SELECT DISTINCT path, regexp_extract(line, 'name=.([^\x22]*)\x22', 1) AS name FROM sc WHERE section = 'node'), k AS (SELECT path, line_no, unnest(['from', 'to']) AS side, unnest([regexp_extract(line, 'from=.([^\x22]*)\x22', 1), regexp_extract(line, 'to=.([^\x22]*)\x22', 1)]) AS name FROM sc WHERE section = 'connection') SELECT path, line_no, side, name FROM k WHERE name <> '.' AND NOT starts_with(name, './') AND NOT EXISTS (SELECT 1 FROM n WHERE n.path = k.path AND (n.name = k.name OR starts_with(k.name, n.name || '/')))")
def jn8(spark, d):
    return K.broken_connections(scenes(spark, d))


@C("grf8_missing", rf"WITH {SCENES} SELECT path, count(*) AS missing FROM c WHERE line LIKE '% = Null(%' OR line LIKE '% = %missing%' GROUP BY path")
def grf8(spark, d):
    gone = scenes(spark, d).filter(F.col("value").startswith("Null(") | F.col("value").contains("missing"))
    return gone.groupBy("path").agg(F.count("*").alias("missing"))


@C("agg17_project_map", f"WITH {FILES} SELECT count(*) AS scripts, sum(len(string_split(content, chr(10))))::BIGINT AS n_lines, count(*) FILTER (contains(content, 'print(')) AS with_prints FROM f")
def agg17(spark, d):
    return files(spark, d).agg(F.count("*").alias("scripts"), F.sum(F.size(F.split("content", "\n", -1))).alias("n_lines"), F.count_if(F.contains("content", F.lit("print("))).alias("with_prints"))


@C("set3_lnt16_removed_variables", rf"WITH {FILES}, v AS (SELECT path, list_distinct(regexp_extract_all(content, 'var (\w+)', 1)) AS v, split_part(path, '/', 1) AS s, regexp_extract(path, '/(\d+)', 1)::BIGINT AS n FROM f) SELECT a.path, len(list_filter(a.v, lambda x: NOT list_contains(coalesce(b.v, []), x)))::INT AS removed FROM v a LEFT JOIN v b ON a.s = b.s AND b.n = a.n + 20")
def set3(spark, d):
    """Variables of a script that the next one of its project lacks."""
    v = files(spark, d).select("path", F.array_distinct(F.regexp_extract_all("content", F.lit(r"var (\w+)"), 1)).alias("v"), F.split_part("path", F.lit("/"), F.lit(1)).alias("s"), F.regexp_extract("path", r"/(\d+)", 1).cast("long").alias("n"))
    new = v.select("s", (F.col("n") - 20).alias("n"), F.col("v").alias("v2"))
    return v.hint("merge").join(new, ["s", "n"], "left").select("path", F.size(F.array_except("v", F.coalesce("v2", F.array().cast("array<string>")))).alias("removed"))


@C("top9_context_files", f"WITH {FILES}, q AS (SELECT path, content, 2 * contains(path, 'src1')::INT + contains(content, 'velocity')::INT + contains(content, 'signal ')::INT AS score FROM f), b AS (SELECT path, score, sum(length(content)) OVER (PARTITION BY split_part(path, '/', 1) ORDER BY score DESC, path) AS spent FROM q WHERE score > 0) SELECT path, score::INT AS score FROM b WHERE spent <= 8000")
def top9(spark, d):
    score = 2 * F.contains("path", F.lit("src1")).cast("int") + F.contains("content", F.lit("velocity")).cast("int") + F.contains("content", F.lit("signal ")).cast("int")
    f = files(spark, d).withColumn("score", score).filter("score > 0").withColumn("s", F.split_part("path", F.lit("/"), F.lit(1)))
    return V.within_budget(f, ["s"], [F.desc("score"), F.col("path")], F.length("content"), 8000).select("path", "score")


@C("flt10_names", r"SELECT page_id, list_filter(regexp_extract_all(lower(html), '[\w\-]+\.com'), lambda x: true)[1] AS first FROM pages WHERE regexp_matches(html, '[\w\-]+\.com')")
def flt10(spark, d):
    first = F.regexp_extract(F.lower("html"), r"[\w\-]+\.com", 0)
    return read(spark, d, "pages").filter(F.col("html").rlike(r"[\w\-]+\.com")).select("page_id", first.alias("first"))


@C("src4_modes", "SELECT doc_id, CASE WHEN contains(source, '1') THEN 'primary' WHEN contains(source, '2') THEN 'secondary' ELSE 'mixed' END AS mode, 'kb_' || source AS topic FROM documents")
def src4(spark, d):
    mode = F.when(F.contains("source", F.lit("1")), "primary").when(F.contains("source", F.lit("2")), "secondary").otherwise("mixed")
    return read(spark, d, "documents").select("doc_id", mode.alias("mode"), F.concat(F.lit("kb_"), "source").alias("topic"))


@C("src9_landed_pages", "SELECT page_id, url FROM pages WHERE length(html) >= 100")
def src9(spark, d):
    return read(spark, d, "pages").filter(F.length("html") >= 100).select("page_id", "url")


@C("txt12_code_lines", f"WITH {FILES} SELECT path, array_to_string(list_slice(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '^(func|var|signal|extends)\\b')), 1, 40), chr(10)) AS code FROM f")
def txt12(spark, d):
    kept = F.slice(F.filter(F.split("content", "\n", -1), lambda x: x.rlike(r"^(func|var|signal|extends)\b")), 1, 40)
    return files(spark, d).select("path", F.array_join(kept, "\n").alias("code"))


@C("win4_packed_blocks")
def win4(spark, d):
    from ..operators.feedback import packed

    text = K.in_blocks(lines(spark, d)).groupBy("path", "block")  # a line carries its block's number
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x.line), "\n")
    return packed(text.agg(joined.alias("text")), 200, 40).select("path", "chunk", F.md5("text").alias("h"))


_file_columns("cls17_quality_gate", lambda: {"score": F.round((100 - F.when(F.length("content") == 0, 50).otherwise(0) - F.when(F.contains("content", F.lit("#")), 0).otherwise(10)) / 100, 2), "passed": F.length("content") > 0},
              "round((100 - CASE WHEN length(content) = 0 THEN 50 ELSE 0 END - CASE WHEN contains(content, '#') THEN 0 ELSE 10 END) / 100, 2) AS score, length(content) > 0 AS passed")


@C("lnt13_lnt14_registered", f"WITH {FILES} SELECT path, regexp_matches(content, 'base\\.gd') AS registered FROM f")
def lnt13(spark, d):
    return files(spark, d).select("path", F.col("content").rlike(r"base\.gd").alias("registered"))


@C("lnt17_hints", f"WITH {FILES} SELECT path, (length(content) - length(replace(content, 'for ', ''))) / 4 > 2 AS loop_hint, len(string_split(content, chr(10))) > 50 AS split_hint FROM f")
def lnt17(spark, d):
    """Hints from the quick issues of a file: loops, length."""
    found = lint.quick_issues(content())
    has = lambda w: F.exists(found, lambda x: F.contains(F.lower(x), F.lit(w)))
    loops = (F.length("content") - F.length(F.replace("content", F.lit("for "), F.lit("")))) / 4 > 2
    return files(spark, d).select("path", (has("loop") | loops).alias("loop_hint"), has("too long").alias("split_hint"))




STRICT = r"h AS (SELECT *, CASE WHEN line LIKE 'class %' THEN 'class' WHEN ltrim(line) LIKE 'func %' THEN 'func' END AS kind FROM c), n AS (SELECT *, count(kind) OVER (PARTITION BY path ORDER BY line_no) AS chunk FROM h), p AS (SELECT path, chunk, min(line_no) AS start_line, max(line_no) AS end_line, max(kind) AS kind, max(CASE WHEN kind = 'func' THEN regexp_extract(ltrim(line), '^func\s+([a-zA-Z_][a-zA-Z0-9_]*)', 1) END) AS function, bool_or(regexp_matches(line, '\S')) AS full_ FROM n GROUP BY path, chunk), x AS (SELECT *, lead(kind) OVER (PARTITION BY path ORDER BY chunk) AS nxt FROM p)"


@C("win1_strict_chunks", f"WITH {LINES}, {STRICT} SELECT path, chunk, function, start_line::INT AS start_line, end_line::INT AS end_line FROM x WHERE full_ AND (nxt IS NULL OR function IS NOT NULL)")
def win1_strict(spark, d):
    """The made scripts have no classes, so what stands before the first function goes."""
    return K.strict_chunks(lines(spark, d)).drop("class")


@C("win13_parentless", rf"WITH {SCENES}, {HEADS}, n AS (SELECT path, line_no, row_number() OVER (PARTITION BY path ORDER BY line_no) AS r FROM sc WHERE section = 'node' AND (NOT contains(line, 'parent=') OR regexp_matches(line, 'parent=\x22\.\x22'))) SELECT path, line_no FROM n WHERE r > 1")
def win13_parentless(spark, d):
    """A parent "." counts as none."""
    return K.orphans(scenes(spark, d), dot_is_root_child=False)


@C("lnt18_connection_warnings", rf"WITH {SCENES} SELECT path, line_no, 'Signal connection found: ' || regexp_extract(line, 'from=.([^\x22]+)\x22', 1) || '.' || regexp_extract(line, 'signal=.([^\x22]+)\x22', 1) || ' -> ' || regexp_extract(line, ' to=.([^\x22]+)\x22', 1) || '.' || regexp_extract(line, 'method=.([^\x22]+)\x22', 1) AS warning FROM c WHERE line LIKE '[connection %'")
def lnt18_warnings(spark, d):
    return K.scene_warnings(_made(spark, d, SCENE, "tscn"))


_WALKED = "list_extract([" + ", ".join(map(quoted, FOLDERS)) + r"], (regexp_extract(path, '/(\d+)\.', 1)::BIGINT % 6 + 1)::INT) || path"
_KEPT = "NOT contains({0}, '.godot') AND NOT contains({0}, 'imports') AND NOT regexp_matches({0}, '(^|/)(\\.git|\\.godot|addons)/')"
_SCENES = _made_sql("k", SCENE, "tscn").replace("l0", "m0").replace("l1", "m1").replace("l2", "m2")


@C("grf9_project_graph", rf"WITH {LINES}, {_SCENES}, {DEPS}, s AS (SELECT *, last_value(CASE WHEN line LIKE '[%' THEN line_no END IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS owner FROM k), x AS (SELECT path, regexp_extract(line, ' id=.([^\x22]*)\x22', 1) AS id, regexp_extract(line, 'path=.res://([^\x22]*)\x22', 1) AS res FROM s WHERE line LIKE '[ext_resource %'), u AS (SELECT s.path, regexp_extract(s.line, 'ExtResource\(.([^\x22]*)\x22', 1) AS id FROM s JOIN s o ON o.path = s.path AND o.line_no = s.owner AND o.line LIKE '[node %' WHERE s.line LIKE 'script = %'), a AS (SELECT src AS path, dst, kind FROM e UNION SELECT u.path, x.res, 'scene' FROM u JOIN x ON u.path = x.path AND u.id = x.id), w AS (SELECT {_WALKED} AS src, dst, kind FROM a) SELECT src, dst, kind FROM w WHERE {_KEPT.format('src')}")
def grf9(spark, d):
    """Scripts and scenes in folders of which a scan leaves some out: one set of edges."""
    from ..operators.analysis import project_graph

    walk = files(spark, d).select("path", "content").unionByName(K.files_of(_made(spark, d, SCENE, "tscn")).select("path", "content"))
    at = F.element_at(F.array(*map(F.lit, FOLDERS)), (F.regexp_extract("path", r"/(\d+)\.", 1).cast("long") % 6 + 1).cast("int"))
    return project_graph(walk.withColumn("path", F.concat(at, "path")))[0]
