"""Static analysis on small hand-made files."""

from __future__ import annotations

from pyspark.sql import functions as F

from textmill.functions import lint
from textmill.operators import analysis as A
from textmill.operators import code as K
from textmill.operators import trees


def files(spark, **texts):
    return spark.createDataFrame([(k.replace("__", "/") + ".gd", v) for k, v in texts.items()], "path string, content string")


def test_extents_of_functions(spark):
    code = "func a():\n\tx\n\n\tfunc inner():\n\t\ty\nvar z\n\tfunc late():\n\t\tq\n\tend\nfunc last(x):\n\tdone"
    out = {(r.name, r.start_line, r.end_line) for r in A.function_extents(K.lines_of(files(spark, f=code))).collect()}
    assert out == {("a", 1, 6), ("late", 7, 9), ("last", 10, 12)}
    asked = spark.createDataFrame([("f.gd", i) for i in range(1, 12)], "path string, line_no int")
    held = {r.line_no: r.name for r in A.covering(A.function_extents(K.lines_of(files(spark, f=code))), asked).collect()}
    assert held == {1: "a", 2: "a", 3: "a", 4: "a", 5: "a", 7: "late", 8: "late", 10: "last", 11: "last"}


def test_findings_and_their_thresholds(spark):
    long = "func _process(delta):\n" + "\tx = 1\n" * 16 + "func f():\n\tpass"
    state = "\n".join(f"var v{i} = 1" for i in range(10))
    texts = {"large": "# c\n" * 501, "edge": "# c\n" * 499, "long": long, "state": state, "docs": "\n".join(f"func f{i}():\n\tpass" for i in range(4))}
    found = A.findings(K.lines_of(files(spark, **texts)))
    assert {(r.path, r.category) for r in found.collect()} == {("large.gd", "Code Size"), ("long.gd", "Performance"), ("state.gd", "Architecture"), ("docs.gd", "Documentation")}
    score = {r.category: r.score for r in found.collect()}
    assert score["Performance"] == round(2 * 1.5 * (1 + 0.05 * 4), 6)


def test_priority_keeps_the_budget_and_high_severity(spark):
    rows = [("p", f"f{i}", None, "Performance", "high" if i == 40 else "low", "m" * 50, "s" * 50, float(100 - i)) for i in range(60)]
    found = spark.createDataFrame(rows, "project string, path string, line_number int, category string, severity string, message string, suggestion string, score double")
    out = [r.path for r in A.priority(found, ["project"]).collect()]
    assert sorted(out) == sorted([f"f{i}" for i in range(13)] + ["f40"])


def test_syntax_issues(spark):
    code = "onready var a = 1\nexport var b = 2\n# emit_signal( in a comment\n  emit_signal('x')\nfunc f() -> int:\n\tpass\nfunc g() -> int:\n\treturn 1\nfunc h() -> int:\n\tpass\n c\n d\n e"
    out = {(r.line_no, r.issue) for r in A.syntax_issues(K.lines_of(files(spark, f=code))).collect()}
    assert out == {(0, "extends"), (1, "onready"), (2, "export"), (4, "emit_signal"), (4, "spaces"), (5, "return"), (11, "spaces"), (12, "spaces")}


def test_names_resolve_whole_then_by_ending_then_by_last_part(spark):
    paths = spark.createDataFrame([(p,) for p in ("b/x.gd", "a/lib/x.gd", "y.gd", "q/y.gd", "C/Z.gd")], "path string")
    names = spark.createDataFrame([(n,) for n in ("lib/x.gd", "x.gd", "else/x.gd", "Y.GD", "c\\z.gd", "none.gd", "")], "name string")
    out = {r.name: r.path for r in A.resolved(names, paths).collect()}
    assert out == {"lib/x.gd": "a/lib/x.gd", "x.gd": "a/lib/x.gd", "else/x.gd": "a/lib/x.gd", "Y.GD": "y.gd", "c\\z.gd": "C/Z.gd"}


def test_cascade_of_a_change(spark):
    f = files(spark, a="signal hit\nfunc go(x):\n", b='extends "res://a.gd"\nhit.connect(x)\ngo(1)', c='extends "res://a.gd"\nspeed = 1')
    code = K.lines_of(f)
    changes = spark.createDataFrame([("a.gd", "Removed signal 'hit'"), ("a.gd", "Changed function go(x)"), ("a.gd", "Renamed export \"speed\""), ("a.gd", "Removed signal '7'")], "target string, change string")
    hits = A.cascade(A.linked(code, f.select("path")), changes, f)
    assert {(r.dependent, r.high, r.medium, r.low) for r in hits.collect()} == {("b.gd", 1, 1, 0), ("c.gd", 0, 0, 1)}
    report = A.cascade_report(hits).collect()[0]
    assert (report.dependents, report.safe, report.n_review) == (2, False, 1)


def test_unsafe_recursion_and_guards(spark):
    free = "func f(a):\n" + "\tf(1)\n" * 3
    out = {r.path: r.reason for r in A.safety(files(spark, free=free, few="func f(a):\n\tf(1)", kept=free + "\tif not f", bad="OS.execute('x')", none="")).collect()}
    assert out == {"free.gd": "Potential unsafe recursion in 'f'", "few.gd": "OK", "kept.gd": "OK", "bad.gd": "System command execution blocked", "none.gd": "Empty code"}


def test_hierarchy_of_any_depth(spark):
    rows = [("s", 1, "root", "."), ("s", 2, "a", "root"), ("s", 3, "b", "a"), ("s", 4, "c", "b"), ("s", 5, "d", "gone"), ("s", 6, "p", "q"), ("s", 7, "q", "p"), ("t", 1, "a", None)]
    out = {(r.path, r.name): (r.full_path, r.depth) for r in trees.hierarchy(spark.createDataFrame(rows, "path string, line_no int, name string, parent string")).collect()}
    assert out == {
        ("s", "root"): ("root", 0), ("s", "a"): ("root/a", 1), ("s", "b"): ("root/a/b", 2), ("s", "c"): ("root/a/b/c", 3),
        ("s", "d"): ("gone/d", 1), ("s", "p"): ("q/p", 1), ("s", "q"): ("p/q", 1), ("t", "a"): ("a", 0),
    }


def test_rewrites(spark):
    code = "for i in x:\n\tpass\nvar a = 0\nvar b = true  \n\n\n\nexport(int) var c\nfor i in range(len(list)):\n\tgo(i)\n\n"
    r = files(spark, f=code).select(lint.rewritten(F.col("content")).alias("r")).collect()[0].r
    assert r.code == "# Empty loop removed\nvar a: int = 0\nvar b: bool = true\n\n@export var c: int\nfor i in list:\n\tgo(i)\n"
    assert (r.n_loops, r.n_hints) == (1, 2)


def test_validation_by_type(spark):
    paths = spark.createDataFrame([(p,) for p in ("a.gd", "b.gd", "s.tscn", "t.tscn", "x.png")], "path string")
    res = spark.createDataFrame([("s.tscn", "a.gd"), ("t.tscn", "gone.gd"), ("t.tscn", "b.gd")], "path string, res string")
    out = {r.path: r.n_errors for r in A.validated(paths, res, spark.createDataFrame([("b.gd",)], "path string")).collect()}
    assert out == {"a.gd": 0, "b.gd": 1, "s.tscn": 0, "t.tscn": 1, "x.png": 1}


def test_empty_tables(spark):
    none = files(spark, f="x").filter("false")
    code = K.lines_of(none)
    assert A.findings(code).count() == A.syntax_issues(code).count() == A.function_extents(code).count() == A.safety(none).count() == 0
