"""Lint rules, metadata and complexity of script files as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of issues and improvements, with their labels.
ISSUES = [
    (r"\bnull\b.*\.\w+", "null dereference risk"),
    (r"while\s+true", "infinite loop risk"),
    (r"get_node\(", "get_node without @onready"),
    (r"print\(", "debug print left in code"),
    (r"_process\(.*\):[\s\S]{0,200}get_node\(", "get_node in _process (expensive)"),
    (r"for .+ in .+:\s*\n\s+for", "nested loop (O(n²) risk)"),
    (r"yield\(", "deprecated yield (use await)"),
    (r"\.connect\(.*,\s*[\"']", "old signal connect syntax"),
    (r"setget\s", "deprecated setget (use property)"),
]
IMPROVEMENTS = [
    (r"(?m)^var\s+\w+\s*=\s*get_node", "consider @onready for node refs"),
    (r"func _process", "check if _physics_process is more appropriate"),
    (r"\bif\s+\w+\s*!=\s*null", "consider is_instance_valid() for safety"),
    (r"#\s*TODO", "unresolved TODO comment"),
    (r"#\s*FIXME", "unresolved FIXME comment"),
    (r"(?m)^\s{12,}", "very deep nesting — consider refactoring"),
]
# Marks of what a script is about.
TAGS = {
    "movement": ["velocity", "move_and_slide", "CharacterBody"],
    "input": ["Input.", "action_pressed", "get_axis"],
    "combat": ["damage", "health", "attack", "hit"],
    "ui": ["Label", "Button", "Panel", "CanvasLayer"],
    "ai": ["NavigationAgent", "pathfind", "chase", "patrol"],
    "physics": ["RigidBody", "Area2D", "collision"],
    "audio": ["AudioStreamPlayer", "play(", "stream"],
    "animation": ["AnimationPlayer", "AnimatedSprite", "anim"],
    "camera": ["Camera2D", "Camera3D", "follow"],
    "signal": ["emit_signal", "connect(", "signal "],
}
# Literals that generated code must not hold, with the reason; the first wins.
BANNED = [
    ("extends Node3D", "Node3D requires 3D resources"),
    ("class_name ", "Global class registration not allowed"),
    ('load("res://', "Dynamic resource loading blocked"),
    ('preload("res://', "Preload blocked in generated code"),
    ("OS.execute(", "System command execution blocked"),
    ("DirAccess.", "Direct filesystem access blocked"),
    ("FileAccess.", "Direct file access blocked"),
    ("HTTPRequest", "Network requests blocked"),
    ("while true:", "Infinite loop detected"),
    ("while True:", "Infinite loop detected"),
]


def findings(content: Column, rules: list[tuple[str, str]]) -> Column:
    """Labels of the rules that match, in the table's order."""
    return F.array_compact(F.array(*[F.when(content.rlike(p), F.lit(label)) for p, label in rules]))


def tags(content: Column) -> Column:
    held = [F.when(F.greatest(*[content.contains(w) for w in words]), F.lit(tag)) for tag, words in TAGS.items()]
    return F.array_compact(F.array(*held))


def functions(content: Column, most: int = 20) -> Column:
    return F.slice(F.regexp_extract_all(content, F.lit(r"(?m)^\s*func\s+(\w+)\s*\("), 1), 1, most)


def complexity(content: Column) -> Column:
    n = lambda p: F.regexp_count(content, F.lit(p))
    score = n(r"(?m)^\s*func\s+\w+") * 2 + n(r"(?m)^\s*(if|elif|else|for|while|match)\b") - n(r"(?m)^\s*signal\s+") * 3 - n("@(?:export|onready)")
    return F.greatest(F.lit(0), score)


def poorly_documented(content: Column) -> Column:
    n = lambda p: F.regexp_count(content, F.lit(p))
    comments, funcs = n(r"(?m)^\s*#"), n(r"(?m)^\s*func\s+\w+")
    few = (comments < F.size(F.split(content, "\n", -1)) / 50) | ((funcs > 5) & (n(r'"""[\s\S]*?"""') == 0))
    return few & (funcs > 3)


def quick_issues(content: Column) -> Column:
    """At most two: length, loops, prints, variables named once."""
    names = F.array_distinct(F.regexp_extract_all(content, F.lit(r"var (\w+)"), 1))
    once = F.filter(names, lambda v: (F.length(content) - F.length(F.replace(content, v, F.lit("")))) / F.length(v) == 1)
    loops = (F.length(content) - F.length(F.replace(content, F.lit("for "), F.lit("")))) / 4
    base = F.array_compact(
        F.array(
            F.when(F.size(F.split(content, "\n", -1)) > 50, F.lit("File too long")),
            F.when(loops > 2, F.lit("Too many loops")),
            F.when(content.contains("print("), F.lit("Debug prints left")),
        )
    )
    return F.slice(F.concat(base, F.transform(once, lambda v: F.concat(F.lit("Unused var: "), v))), 1, 2)


def banned(content: Column) -> Column:
    out = F.when(F.length(content) == 0, "Empty code")
    for literal, reason in BANNED:
        out = out.when(content.contains(literal), reason)
    return out.otherwise("OK")


def loop_safety(content: Column) -> Column:
    endless = content.rlike(r"(?i)while\s+true\s*:") & ~content.contains("break")
    calls = [F.when(content.contains(f), F.lit(f"Dangerous function call: {f}")) for f in ("OS.execute", "File.open", "Directory.open")]
    return F.array_compact(F.array(F.when(endless, F.lit("Potential infinite loop detected")), *calls))


def signals(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(r"(?m)^[ \t]*signal\s+(\w+)"), 1)


def variables(content: Column, most: int = 15) -> Column:
    """Names after var, const, @export or @onready."""
    return F.slice(F.regexp_extract_all(content, F.lit(r"(?m)^[ \t]*(?:var|const|@export|@onready)\s+(\w+)"), 1), 1, most)


# What a rewrite puts in place of a pattern, by step and in this order; the last is a literal that all the pattern's matches hold.
EMPTY_LOOPS = [(r"for\s+\w+\s+in\s+[^:]+:\s*\n\s*pass", "# Empty loop removed", "pass"), (r"while\s+True:\s*\n\s*pass", "# Infinite empty loop removed", "True:")]
SPACES = [(r"\n\s*\n\s*\n", "\n\n", "\n"), (r"(?m)[ \t\r\f\x0B]+$", "", ""), (r"\s+\z", "", "")]
EXPORTS = [(r"export\s*\(\s*(int|float|String|bool)\s*\)\s+var\s+(\w+)", "@export var $2: $1", "export")]
LOOPS = [(r"for (\w+) in range\(len\((\w+)\)\)", "for $1 in $2", "in range(len(")]
LOOSE_LOOP = r"for\s+\w+\s+in\s+range\s*\(\s*len\s*\(\s*\w+\s*\)\s*\)"
HINTS = [
    (r'(var\s+\w+)\s*=\s*""', '$1: String = ""', '""'),
    (r"(var\s+\w+)\s*=\s*0(?!\d)", "$1: int = 0", "0"),
    (r"(var\s+\w+)\s*=\s*true", "$1: bool = true", "true"),
    (r"(var\s+\w+)\s*=\s*false", "$1: bool = false", "false"),
]


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is made once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def _replaced(text: Column, rules: list[tuple[str, str, str]]) -> Column:
    def put(pattern: str, new: str, held: str) -> Callable[[Column], Column]:
        return lambda t: F.when(F.contains(t, F.lit(held)), F.regexp_replace(t, F.lit(pattern), F.lit(new))).otherwise(t)

    for rule in rules:
        text = _bound(text, put(*rule))
    return text


def without_repeated_signals(content: Column) -> Column:
    """The code with each signal's first declaration only; the word after signal tells them apart. The code is cut before these lines, their words are
    sorted, and a word like the one before it loses its line: work grows with the code and not with its square."""
    blank = r"[ \t\x0B\f\r]"
    cut = F.split(F.concat(F.lit("\n\n"), content), rf"(?=\n{blank}*signal{blank}+\w)", -1)  # the first part holds no declaration
    word = lambda x, i: F.struct(F.regexp_extract(x, r"^\s*signal\s+(\S+)", 1).alias("word"), i.alias("i"))
    again = lambda s: F.transform(s, lambda x, j: F.struct(x["i"].alias("i"), ((x["word"] != "") & F.coalesce(F.get(s, j - 1)["word"] == x["word"], F.lit(False))).alias("again")))

    def once(parts: Column) -> Column:
        marks = F.array_sort(_bound(F.array_sort(F.transform(parts, word)), again))
        return F.array_join(F.transform(F.arrays_zip(parts.alias("part"), marks.alias("mark")), lambda x: F.when(x["mark"]["again"], F.regexp_replace(x["part"], r"^\n[^\n]*", "")).otherwise(x["part"])), "")

    return F.substring(_bound(cut, once), 3, 2**31 - 1)


def rewritten(content: Column) -> Column:
    """Struct of the code with repeated signals, empty loops, white space, exports, loops over lengths and type hints put right,
    n_loops and n_hints (kinds of hints given). Hints for floats aren't given."""
    once = without_repeated_signals(content)
    tidy = _replaced(F.concat(_replaced(_replaced(once, EMPTY_LOOPS), SPACES), F.lit("\n")), EXPORTS)
    n_loops = lambda t: F.when(~F.contains(t, F.lit("range")), 0).otherwise(F.regexp_count(t, F.lit(LOOSE_LOOP))).alias("n_loops")
    done = _bound(tidy, lambda t: F.struct(_replaced(t, LOOPS).alias("code"), n_loops(t), F.lit(0).alias("n_hints")))
    hinted = lambda old: lambda new: F.struct(new.alias("code"), old["n_loops"].alias("n_loops"), (old["n_hints"] + (new != old["code"]).cast("int")).alias("n_hints"))
    step = lambda rule: lambda s: _bound(_replaced(s["code"], [rule]), hinted(s))
    for rule in HINTS:  # no kind of hint makes or takes what another looks for
        done = _bound(done, step(rule))
    return done


def compared_parts(content: Column) -> Column:
    """Struct of what ``compared`` looks at in one version: much shorter than the code."""
    process = r"func\s+_process\s*\(([^)]*)\)"
    return F.struct(
        F.array_distinct(F.regexp_extract_all(content, F.lit(r"var\s+(\w+)"), 1)).alias("names"),
        F.regexp_count(content, F.lit(r"(?:print|push_warning|push_error)\s*\(")).alias("prints"),
        F.regexp_extract(content, r"(?m)^extends\s+(\w+)", 1).alias("extends"),
        content.rlike(process).alias("process"),
        F.contains(F.regexp_extract(content, process, 1), F.lit("delta")).alias("delta"),
    )


def compared(old: Column, new: Column) -> Column:
    """Struct of what a new version of a script lacks (variables; prints and warnings, by their number) or adds: the name after extends
    where the old one had none, and delta among the parameters of _process where the old one's lacked it."""
    return compared_by(compared_parts(old), compared_parts(new))


def compared_by(old: Column, new: Column) -> Column:
    return F.struct(
        F.size(F.array_except(old["names"], new["names"])).alias("removed_vars"),
        F.greatest(F.lit(0), old["prints"] - new["prints"]).alias("removed_prints"),
        F.when(old["extends"] == "", new["extends"]).otherwise("").alias("added_extends"),
        (old["process"] & new["process"] & ~old["delta"] & new["delta"]).alias("added_delta"),
    )
