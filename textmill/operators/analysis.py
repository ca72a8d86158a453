"""Static analysis of script files, given as lines (path, line_no, line) or files (path, content):
findings and their priority, syntax issues, function extents, unsafe recursion, resolution of names,
cascades of a change, validation of a set of files."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import lint
from ..sources.readers import pruned
from . import code as K
from . import windows as V
from .scratch import written

# Thresholds and weights of findings.
LARGE, LONG_PROCESS, MANY_GLOBALS, BUDGET, OVERHEAD = 500, 15, 10, 2000, 50
SEVERITY = {"high": 3.0, "medium": 2.0, "low": 1.0}
CATEGORY = {"Performance": 1.5, "Architecture": 1.3, "Code Size": 1.2, "Documentation": 0.8}
# What a finding advises; its length is part of its cost.
ADVICE = {
    "Code Size": "Consider splitting into smaller modules or components",
    "Performance": "Move complex logic to dedicated methods or use signals/timers",
    "Architecture": "Consider using dependency injection or signal-based communication",
    "Documentation": "Add docstrings to public functions and class-level documentation",
}
LOADED = r"""(?:load|preload)\s*\(\s*["']([^"']*\.gd)["']\s*\)"""
ABSOLUTE = r"""get_node\s*\(\s*["'](/[^"']*)["']\s*\)"""
PATH_NODE = r"""get_node\s*\(\s*["'][^"']*/[^"']*["']\s*\)"""


FN = r"^\s*func\s+\w+"


def _hits(pattern: str) -> Column:
    """How often a pattern that stays within a line is found in the whole content."""
    return F.regexp_count("content", F.lit(f"(?md){_in_line(pattern)}"))


def _in_line(pattern: str) -> str:
    return pattern.replace("[^\"']*", r"""[^"'\n]*""").replace(r"\s", r"[^\S\n]")


def _marked(files: DataFrame) -> DataFrame:
    """``files`` with marks, a sign a line in order: P and its line number and a colon for _process, F other functions, V globals, O other code without
    indent, # a comment without indent, c one with it, v variables with indent, b other lines with text, blank for the rest; and n_lines. What a pattern
    must hold is looked for first, which costs less."""
    holds = lambda x, *words: functools.reduce(lambda a, b: a | b, [F.contains(x, F.lit(w)) for w in words])

    def mark(x, i):
        flat = x.rlike(r"^\S")
        head = holds(x, "_process") & x.rlike(r"^\s*func\s+_process\s*\(")
        var = holds(x, "var", "const") & x.rlike(r"^\s*(var|const)\s+\w+\s*[:=]")
        fn = F.when(head, F.concat(F.lit("P"), i + 1, F.lit(":"))).otherwise("F")
        comment = F.when(F.startswith(x, F.lit("#")), "#").otherwise("c")
        return F.when(holds(x, "func") & x.rlike(FN), fn).when(var, F.when(flat, "V").otherwise("v")).when(holds(x, "#") & x.rlike(r"^\s*#"), comment).when(flat, "O").when(x.rlike(r"\S"), "b").otherwise(" ")

    ls = F.split("content", "\n", -1)
    return files.withColumn("marks", F.transform(ls, mark)).select(*files.columns, F.size("marks").alias("n_lines"), F.array_join("marks", "").alias("marks"))


def _files(code: DataFrame) -> DataFrame:
    return code if "content" in code.columns else K.files_of(code)


def measures(code: DataFrame) -> DataFrame:
    """Of code(path, content), one row a path, or lines(path, line_no, line): n_lines, comments, functions, docstrings, global-state indicators, complexity, the number of
    things it depends on (loaded scripts, absolute node paths) and bodies, the long ones of _process. No line becomes a row."""
    signs = lambda of, c="marks": F.length(F.regexp_replace(c, f"[^{of}]", ""))
    outside = signs("Vv", F.regexp_replace("marks", "[PF][^VO]*", ""))  # variables after the last function that code without indent has ended
    # patterns that begin with one word and plain searches take less than alternatives; load is the end of preload
    links = F.concat(*[F.regexp_extract_all("content", F.lit(_in_line(p)), 1) for p in (LOADED.replace("(?:load|preload)", "load"), ABSOLUTE)])
    shared = F.contains(F.lower("content"), F.lit("static")) | F.contains(F.lower("content"), F.lit("singleton"))
    dollars = F.length("content") - F.length(F.replace("content", F.lit("$"), F.lit("")))
    coupled = (_hits(r"get_tree\s*\(") > 5) | (_hits(r"get_node\s*\(") + dollars > 10)
    score = signs("PF") * 2 + _hits(r"^\s*(if|elif|else|for|while|match)\b") - _hits(r"^\s*signal\s") * 3 - _hits("@(?:export|onready)")
    body = lambda x: F.struct(F.regexp_extract(x, "[0-9]+", 0).cast("int").alias("line_number"), signs("vb", x).alias("body_lines"))
    return _marked(_files(code)).select(
        "path",
        F.col("n_lines").cast("long").alias("n_lines"),
        signs("#c").cast("long").alias("comments"),
        signs("PF").cast("long").alias("functions"),
        F.floor(_hits('"""') / 2).alias("docstrings"),
        (outside + F.when(shared, 3).otherwise(0) + F.when(coupled, 2).otherwise(0)).cast("long").alias("globals"),
        F.greatest(F.lit(0), score).cast("long").alias("complexity"),
        F.size(F.array_distinct(links)).alias("n_links"),
        F.filter(F.transform(F.regexp_extract_all("marks", F.lit("P[0-9]+:[vbc ]*"), 0), body), lambda b: b.body_lines > LONG_PROCESS).alias("bodies"),
    )


def findings(code: DataFrame) -> DataFrame:
    """Of files or lines: (path, line_number, category, severity, message, suggestion, score): large files, global state,
    missing documentation, long _process bodies. The score weighs severity and category by what the file
    depends on and its complexity. A file's findings are made from its row."""
    undocumented = ((F.col("comments") < F.col("n_lines") / 50) | ((F.col("functions") > 5) & (F.col("docstrings") == 0))) & (F.col("functions") > 3)

    def row(category, severity, *message, line=None):
        text = F.concat(*[F.lit(m) if i % 2 == 0 else (F.col(m) if isinstance(m, str) else m).cast("string") for i, m in enumerate(message)])
        at = F.lit(None) if line is None else line
        return F.struct(at.cast("int").alias("line_number"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), text.alias("message"))

    of_file = F.array_compact(
        F.array(
            F.when(F.col("n_lines") > LARGE, row("Code Size", "medium", "Large script (", "n_lines", " lines)")),
            F.when(F.col("globals") >= MANY_GLOBALS, row("Architecture", "low", "Heavy global state (", "globals", " indicators)")),
            F.when(undocumented, row("Documentation", "low", "Minimal documentation (", "comments", " comments, ", "functions", " functions)")),
        )
    )
    long = F.transform("bodies", lambda b: row("Performance", "medium", "_process contains ", b.body_lines, " lines of logic", line=b.line_number))
    factor = (1 + 0.2 * F.col("n_links") + 0.05 * F.col("complexity")).alias("factor")
    weight = lambda c, table: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col(c)]
    # an outer explode, as an inner one would have every column made twice
    out = measures(code.filter("path IS NOT NULL")).select("path", factor, F.explode_outer(F.concat(of_file, long)).alias("f")).filter("f IS NOT NULL").select("path", "f.*", "factor")
    out = out.withColumn("suggestion", weight("category", ADVICE))
    return out.withColumn("score", F.round(weight("severity", SEVERITY) * weight("category", CATEGORY) * F.col("factor"), 6)).drop("factor")


def priority(found: DataFrame, by: list[str], budget: int = BUDGET) -> DataFrame:
    """By score, findings of each project within a budget of characters; high severity always. A finding
    costs over 50, so only the first budget / 50 of each project can fit: Spark limits them in each task. Findings are written
    first, as they are read twice and making them reads all code."""
    found = written(found, "findings")
    cost = F.length("message") + F.length("suggestion") + OVERHEAD
    order = [F.desc("score"), F.col("path"), F.col("category"), F.asc_nulls_first("line_number")]
    within = V.within_budget(found, by, order, cost, budget, least=OVERHEAD).drop("spent")
    rest = found.filter("severity = 'high'")
    return within.unionByName(rest.hint("merge").join(within.filter("severity = 'high'"), [*by, "path", "category", "message"], "left_anti"))


def without_extends(code: DataFrame) -> DataFrame:
    """(path) of the files without an extends line; code(path, ls) with a file's lines as an array or (path, line_no, line)."""
    extends = lambda x: F.contains(x, F.lit("extends ")) & x.rlike(r"^\s*extends ")
    has = F.bool_or(F.exists("ls", extends) if "ls" in code.columns else extends(F.col("line")))
    return code.groupBy("path").agg(has.alias("has")).filter(~F.col("has")).select("path")


def syntax_issues(lines: DataFrame) -> DataFrame:
    """(path, line_no, issue); line_no 0 speaks of the whole file, a function's of its header. Blank lines
    and comments aren't looked at; spaces as indentation are told of the first three lines of a file; the
    last function of a file isn't asked for its return. Only lines that may tell something are put in order, once."""
    line = F.col("line")
    bare = without_extends(lines).select("path", F.lit(0).alias("line_no"), F.lit("extends").alias("issue"))
    said = F.array_compact(
        F.array(
            F.when(line.rlike(r"\bonready\b") & ~line.contains("@onready"), F.lit("onready")),
            F.when(line.rlike(r"^\s*export\s+var\b"), F.lit("export")),
            F.when(line.contains("emit_signal("), F.lit("emit_signal")),
            F.when(line.rlike(r"\bsetget\b"), F.lit("setget")),
        )
    )
    header = r"^func\s+(\w+)\s*\(.*\)\s*(->\s*\S+)?\s*:"
    typed = F.regexp_extract("line", header, 2)
    live = lines.filter(line.rlike(r"^\s*[^\s#]"))
    marked = live.select(
        "path", "line_no", said.alias("said"), line.startswith(" ").alias("spaces"), line.rlike(header).alias("head"),
        ((typed != "") & ~typed.contains("void")).alias("typed"), line.contains("return").alias("returns"),
    ).filter("size(said) > 0 OR spaces OR head OR returns")
    nth = F.sum(F.col("spaces").cast("int")).over(K.so_far())
    # a function lacks its return if, of headers and returns, a header comes next
    then = F.expr("lead(CASE WHEN head OR returns THEN head END) IGNORE NULLS OVER (PARTITION BY path ORDER BY line_no)")
    told = marked.withColumns({"nth": nth, "then": then})
    issues = F.array_compact(F.concat("said", F.array(F.when(F.col("spaces") & (F.col("nth") <= 3), F.lit("spaces")), F.when(F.col("head") & F.col("typed") & F.col("then"), F.lit("return")))))
    return told.select("path", "line_no", F.explode(issues).alias("issue")).unionByName(bare)


def _extents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in order -> their outermost functions: one is open at a time, and it may go on in the next batch."""
    names = ["path", "name", "start_line", "end_line", "n"]
    path = at = None  # at: name, start, indent and what was counted before the open function
    for b in batches:
        out = []
        for p, no, indent, name, before, upto, last in zip(*[c.to_pylist() for c in b.columns]):
            if p != path:
                path, at = p, None
            if at and indent is not None and indent <= at[2]:
                out.append((p, at[0], at[1], no, before - at[3]))
                at = None
            if at is None and name is not None:
                at = name, no, indent, before
            if at and last:
                out.append((p, at[0], at[1], no + 1, upto - at[3]))
                at = None
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64()])], names)


def function_extents(lines: DataFrame, counted: Column | None = None) -> DataFrame:
    """(path, name, start_line, end_line): a function ends before the next line with text whose indent isn't
    deeper than its own; functions inside another are part of it. One pass over the lines in order, of which those
    that can neither open nor close a function (as deep as the line with text before, and that no header) are left out. With
    ``counted`` also n, the number of a function's lines for which it holds."""
    line = F.col("line")
    text = line.rlike(r"\S")
    called = F.regexp_extract("line", r"^\s*func\s+(\w+)\s*\(", 1)
    name = F.when(line.rlike(r"^\s*func "), F.when(called == "", "unknown_func").otherwise(called))
    own = F.lit(0) if counted is None else F.coalesce(counted.cast("int"), F.lit(0))
    rows = lines.filter("path IS NOT NULL").select("path", F.col("line_no").cast("int").alias("line_no"), F.when(text, F.length(F.regexp_extract("line", r"^(\s*)", 1))).alias("indent"), name.alias("name"), own.alias("own"))
    ahead = F.last(F.when(F.col("indent").isNotNull(), F.struct("indent", F.col("name").isNotNull().alias("head"))), True).over(K.in_order().rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumns({"ahead": ahead, "upto": F.sum("own").over(K.so_far()), "last": F.lead("line_no").over(K.in_order()).isNull()})
    may = F.col("last") | F.col("name").isNotNull() | (F.col("indent").isNotNull() & (F.col("ahead").isNull() | F.col("ahead.head") | (F.col("indent") < F.col("ahead.indent"))))
    asked = rows.filter(may).sortWithinPartitions("path", "line_no").select("path", "line_no", "indent", "name", (F.col("upto") - F.col("own")).alias("before"), "upto", "last")
    out = asked.mapInArrow(_extents, "path string, name string, start_line int, end_line int, n long")
    return out if counted is not None else out.drop("n")


def covering(functions: DataFrame, asked: DataFrame) -> DataFrame:
    """(path, line_no, name) of the function that holds each asked line. Functions of a file don't overlap,
    so it is the last one that begins before: a window over both, not a range join."""
    both = functions.select("path", F.col("start_line").alias("line_no"), F.lit(0).alias("kind"), F.struct("name", "end_line").alias("f")).unionByName(
        asked.select("path", "line_no", F.lit(1).alias("kind")), allowMissingColumns=True
    )
    last = F.last("f", True).over(W.partitionBy("path").orderBy("line_no", "kind").rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn("f", last).filter((F.col("kind") == 1) & (F.col("f.end_line") > F.col("line_no"))).select("path", "line_no", F.col("f.name").alias("name"))


def recursive(files: DataFrame) -> DataFrame:
    """(path, name): the first function, by name, that its file calls more than three times without a guard. A guard is a word after
    "if not " or "if !" that begins with the name; of a file's guards in order, that is the first one from the name on, if any."""
    every = lambda pattern: F.regexp_extract_all("content", F.lit(pattern), 1)
    calls = files.select("path", F.explode_outer(every(r"(\w+)\s*\([^)]*\)")).alias("name")).filter("name IS NOT NULL")
    often = calls.groupBy("path", "name").agg(F.count("*").alias("n")).filter("n > 3")
    told = F.concat(F.transform(F.array_distinct(every(r"(?m)^func\s+(\w+)\s*\(")), lambda x: F.struct(x.alias("name"), F.lit(0).alias("kind"))), F.transform(F.array_distinct(every(r"if (?:not |!)(?=(\w+))")), lambda x: F.struct(x.alias("name"), F.lit(1).alias("kind"))))
    rows = files.select("path", F.explode_outer(told).alias("t")).filter("t IS NOT NULL").select("path", "t.name", "t.kind")
    from_here = W.partitionBy("path").orderBy(F.desc("name"), F.desc("kind")).rowsBetween(W.unboundedPreceding, 0)
    guard = F.last(F.when(F.col("kind") == 1, F.col("name")), True).over(from_here)
    free = rows.withColumn("guard", guard).filter("kind = 0 AND NOT coalesce(startswith(guard, name), false)").select("path", "name")
    return free.hint("merge").join(often, ["path", "name"]).groupBy("path").agg(F.min("name").alias("name"))


def safety(files: DataFrame) -> DataFrame:
    """(path, reason): banned literals first, then recursion, else OK."""
    first = files.select("path", lint.banned(F.col("content")).alias("reason"))
    reason = F.when((F.col("reason") == "OK") & F.col("name").isNotNull(), F.concat(F.lit("Potential unsafe recursion in '"), "name", F.lit("'"))).otherwise(F.col("reason"))
    return first.hint("merge").join(recursive(files), "path", "left").select("path", reason.alias("reason"))


def expert(files: DataFrame, lines: DataFrame) -> DataFrame:
    """(path, n_issues, n_suggestions, score): physics in _process, node paths, connections that nothing ends,
    a _ready of over 15 lines with text, over three magic numbers."""
    c = F.col("content")
    physics = (c.contains("_process(") & c.rlike("velocity|physics|collision")).cast("int")
    leak = (c.contains("connect(") & ~c.contains("_exit_tree") & (c.contains("self.") | c.contains("func "))).cast("int")
    nodes = F.regexp_count(c, F.lit(PATH_NODE))
    magic = (F.regexp_count(c, F.lit(r"\b\d{2,}\b")) > 3).cast("int")
    body = F.col("line").rlike(r"\S") & ~F.col("line").rlike(r"^\s*func ")
    held = function_extents(lines, body).filter("name = '_ready'").groupBy("path").agg(F.sum("n").alias("n"))
    long = (F.coalesce("n", F.lit(0)) > 15).cast("int")
    out = files.select("path", (physics + leak + nodes).alias("i"), (physics + magic).alias("s")).hint("merge").join(held, "path", "left")
    return out.select("path", (F.col("i") + long).alias("n_issues"), F.col("s").alias("n_suggestions")).withColumn("score", F.greatest(F.lit(0), 100 - 10 * F.col("n_issues") - 5 * F.col("n_suggestions")))


def references(lines: DataFrame) -> DataFrame:
    """(src, dst, kind) of extends, preload and load, as written after res://."""
    return K.dependencies(lines)


def resolved(names: DataFrame, paths: DataFrame) -> DataFrame:
    """names(name), paths(path) -> (name, path): the path that equals the name, else the first that ends with it
    at a folder's edge, else the first with its last part; letter case doesn't count. Every path gives its few
    endings, each with its first path, so both steps are equi-joins with one row a name."""
    parts = F.split(F.lower("path"), "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    table = paths.select("path", F.posexplode(ends).alias("p", "ending")).groupBy("ending").agg(F.min(F.struct((F.col("p") > 0).alias("part"), "path")).alias("best")).select("ending", "best.path")
    asked = names.select("name").distinct().withColumn("full", F.lower(F.replace("name", F.lit("\\"), F.lit("/")))).withColumn("base", F.substring_index("full", "/", -1))
    whole = asked.hint("merge").join(table.withColumnRenamed("ending", "full"), "full", "left").withColumnRenamed("path", "w")
    both = whole.hint("merge").join(table.withColumnRenamed("ending", "base"), "base", "left")
    return both.select("name", F.coalesce("w", "path").alias("path")).filter("path IS NOT NULL")


def linked(lines: DataFrame, paths: DataFrame) -> DataFrame:
    """(src, dst): references between the files at hand, by resolution; a file's own path is left out."""
    return linked_names(K.dependencies(lines), paths)


def linked_names(refs: DataFrame, paths: DataFrame) -> DataFrame:
    """refs(src, dst), dst as written -> (src, dst) as linked."""
    to = resolved(refs.select(F.col("dst").alias("name")), paths)
    out = refs.hint("merge").join(to, refs.dst == to.name).select("src", F.col("path").alias("dst"))
    return out.filter("src <> dst").distinct()


def expanded(lines: DataFrame, paths: DataFrame, most_deps: int = 5, most_files: int = 3) -> DataFrame:
    """(target, pos, path): a file, then what it depends on: of its first ``most_deps`` references by name those
    that resolve, ``most_files`` files in all."""
    refs = V.last_n(K.dependencies(lines).select("src", "dst").distinct(), ["src"], [F.col("dst")], most_deps)
    to = resolved(refs.select(F.col("dst").alias("name")), paths)
    found = refs.hint("merge").join(to, refs.dst == to.name).groupBy("src", "path").agg(F.min("dst").alias("dst")).filter("src <> path")
    deps = V.last_n(found, ["src"], [F.col("dst"), F.col("path")], most_files - 1).select(F.col("src").alias("target"), F.col("rank").alias("pos"), "path")
    return paths.select(F.col("path").alias("target"), F.lit(0).alias("pos"), "path").unionByName(deps)


def named_changes(change: Column) -> Column:
    """Array of (severity, name) that a change's text speaks of: a quoted signal, a called function, a quoted variable."""
    low = F.lower(change)
    quoted = F.filter(F.transform(F.regexp_extract_all(change, F.lit(r"""('[^']+'|"[^"]+")"""), 1), lambda x: x.substr(F.lit(2), F.length(x) - 2)), lambda x: ~x.rlike(r"^\d+$"))
    signal, variable = F.get(quoted, F.lit(0)), F.get(F.filter(quoted, lambda x: ~x.startswith("signal")), F.lit(0))
    called = F.nullif(F.regexp_extract(change, r"(\w+)\(", 1), F.lit(""))
    of = lambda severity, name, said: F.when(said, F.struct(F.lit(severity).alias("severity"), name.alias("name")))
    found = F.array(
        of("HIGH", signal, low.contains("signal")),
        of("MEDIUM", called, low.contains("function") | low.contains("method")),
        of("LOW", variable, low.contains("variable") | low.contains("export")),
    )
    return F.filter(found, lambda c: c["name"].isNotNull())  # asked of what was found: a name asked for null first is looked for twice


SEVERITIES = ("HIGH", "MEDIUM", "LOW")


def words_in(content: Column) -> Column:
    """The distinct words of a content, a line each. A name of word characters stands within one word, so this is searched instead of the code."""
    return F.array_join(F.array_distinct(F.regexp_extract_all(content, F.lit(r"\w+"), 0)), "\n")


def _of(severity: str) -> Callable[[Column], Column]:
    return lambda c: c["severity"] == severity


def holding(edges: DataFrame, named: DataFrame, texts: DataFrame) -> DataFrame:
    """edges(src, dst), named(target, cs), an array of (severity, name), texts(path, text) -> (target, dependent, high, medium, low). A target's
    names go to its dependents, so a text is shuffled once, however much it depends on, and what a target that many depend on
    makes to be searched is spread over its dependents."""
    names = [F.transform(F.filter("cs", _of(s)), lambda c: c["name"]).alias(s.lower()) for s in SEVERITIES]
    asked = edges.select(F.col("src").alias("path"), F.col("dst").alias("target")).hint("merge").join(named.select("target", *names), "target")
    n = [F.size(F.filter(s.lower(), lambda x: F.contains("text", x))).alias(s.lower()) for s in SEVERITIES]
    return asked.hint("merge").join(texts, "path").select("target", F.col("path").alias("dependent"), *n)


def cascade(edges: DataFrame, changes: DataFrame, files: DataFrame) -> DataFrame:
    """edges(src, dst), changes(target, change), files(path, content) -> (target, dependent, high, medium, low): how
    many changes of the target name something that its dependent holds. Changes of a target travel as one array. A name of word
    characters is searched in a file's distinct words, not its code; other names are searched in the code."""
    named = changes.select("target", F.explode(named_changes(F.col("change"))).alias("c"))
    named = written(named.groupBy("target").agg(F.collect_list("c").alias("cs")), "changes")
    plain = lambda c: c["name"].rlike(r"^\w+\z")
    out = holding(edges, named.withColumn("cs", F.filter("cs", plain)), files.select("path", words_in(F.col("content")).alias("text")))
    odd = named.withColumn("cs", F.filter("cs", lambda c: ~plain(c))).filter("size(cs) > 0")
    if odd.isEmpty():
        return out
    both = out.unionByName(holding(edges, odd, files.select("path", F.col("content").alias("text"))))
    return both.groupBy("target", "dependent").agg(*[F.sum(s.lower()).cast("int").alias(s.lower()) for s in SEVERITIES])


def cascade_report(hits: DataFrame) -> DataFrame:
    """Per target: dependents, warnings by severity, whether it is safe, how many files need a review."""
    high = F.sum("high")
    return hits.groupBy("target").agg(
        F.count("*").alias("dependents"), high.alias("high"), F.sum("medium").alias("medium"), F.sum("low").alias("low"),
        (high == 0).alias("safe"), F.count_if(F.col("high") > 0).alias("n_review"),
    )


def validated(paths: DataFrame, resources: DataFrame, syntax: DataFrame) -> DataFrame:
    """paths(path), resources(path, res), syntax(path) -> (path, n_errors, is_valid): scripts by their syntax issues, scenes
    by resources that no path has, other types are invalid."""
    gone = resources.hint("merge").join(paths.select(F.col("path").alias("res")).distinct(), "res", "left_anti").select("path")
    errors = gone.unionByName(syntax.select("path")).groupBy("path").agg(F.count("*").alias("n"))
    known = F.col("path").rlike(r"\.(gd|tscn)$")
    out = paths.hint("merge").join(errors, "path", "left")
    n = F.when(known, F.coalesce("n", F.lit(0))).otherwise(1)
    return out.select("path", n.cast("long").alias("n_errors"), (n == 0).alias("is_valid"))


def attachments(rows: DataFrame) -> DataFrame:
    """Scene rows -> (script, scene, node): the scripts that nodes hold by a resource's id."""
    res = rows.filter("section = 'ext_resource'").select("path", F.col("a_id").alias("id"), F.regexp_replace("a_path", "^res://", "").alias("script"))
    owners = rows.filter("section = 'node'").select("path", F.col("line_no").alias("owner"), F.col("a_name").alias("node"))
    held = rows.filter("key = 'script'").select("path", "owner", F.regexp_extract("value", r'ExtResource\("([^"]*)"', 1).alias("id"))
    return held.hint("merge").join(res, ["path", "id"]).hint("merge").join(owners, ["path", "owner"]).select("script", F.col("path").alias("scene"), "node")


def project_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files(path, content) of a walk -> the edges (src, dst, kind) of its scripts and scenes, and (path) of the files that
    a project's scan doesn't leave out. Scripts depend on what they extend, preload and load, scenes on the scripts of their nodes."""
    kept = files.filter(~pruned(F.col("path")))
    ext = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))
    scripts = K.dependencies(K.lines_of(kept.filter(ext == "gd"))).select("src", "dst", "kind")
    scenes = attachments(K.scene_rows(K.lines_of(kept.filter(ext == "tscn")))).select(F.col("scene").alias("src"), F.col("script").alias("dst"), F.lit("scene").alias("kind"))
    return scripts.unionByName(scenes).distinct(), kept.select("path").distinct()
