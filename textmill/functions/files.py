"""Columns over files of a project or a knowledge base: modes and topics by name, autoloads, bindings, features, relevance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a knowledge file's name says of its mode; the first that the name holds counts.
MODES = {
    "godot": "coding", "cpp": "coding", "unreal": "coding", "unity": "coding", "javascript": "coding", "design_patterns": "coding",
    "general_facts": "general", "artificial_intelligence": "general", "machine_learning": "general", "programming": "general",
    "software_engineering": "general", "data_structures": "coding", "algorithms": "coding", "python": "coding", "rust": "coding",
    "web_development": "coding", "database": "coding", "linux": "general", "science": "general", "technology": "general",
}
# Topics by a knowledge file's name, again the first that it holds.
TOPICS = {
    "godot_engine": ["godot", "game engine", "gdscript", "nodes"],
    "cpp_basics": ["c++", "memory", "pointers", "oop"],
    "unreal_engine": ["unreal", "blueprints", "cpp", "game development"],
    "unity_engine": ["unity", "c#", "components", "game development"],
    "javascript_basics": ["javascript", "web", "async", "dom"],
    "design_patterns": ["patterns", "architecture", "singleton", "factory"],
    "general_facts": ["general", "facts", "trivia", "lifestyle"],
    "artificial_intelligence": ["ai", "artificial intelligence", "neural networks", "deep learning"],
    "machine_learning": ["machine learning", "ml", "training", "models"],
    "programming": ["programming", "coding", "software", "development"],
    "software_engineering": ["software engineering", "best practices", "testing", "debugging"],
    "data_structures": ["data structures", "arrays", "trees", "graphs", "hash tables"],
    "algorithms": ["algorithms", "sorting", "searching", "complexity", "optimization"],
    "python": ["python", "scripting", "automation", "data science"],
    "rust": ["rust", "systems programming", "memory safety", "performance"],
    "web_development": ["web", "html", "css", "frontend", "backend"],
    "database": ["database", "sql", "nosql", "queries", "indexing"],
    "linux": ["linux", "unix", "shell", "terminal", "sysadmin"],
    "science": ["science", "physics", "mathematics", "research"],
    "technology": ["technology", "tech news", "innovation", "gadgets"],
}
# The words that a feedback entry's features count.
KEYWORDS = "signal|export|onready|var|const|enum|func|class|extends|yield|await|match|break|continue|return|if|elif|else|for|while|try|catch|except|finally|node|scene|tree|process|physics|input"
# Terms that every question about code is taken to ask for.
CODE_TERMS = ["func", "var", "signal", "class", "extends", "if", "for", "while"]


def _first(name: Column, table: dict, of, default: Column) -> Column:
    out = None
    for key, value in table.items():
        out = (F if out is None else out).when(F.contains(F.lower(name), F.lit(key)), of(value))
    return out.otherwise(default)


def mode_of(stem: Column) -> Column:
    return _first(stem, MODES, F.lit, F.lit("mixed"))


def topics_of(stem: Column) -> Column:
    return _first(stem, TOPICS, lambda ts: F.array(*map(F.lit, ts)), F.array().cast("array<string>"))


def autoloads(project: Column) -> Column:
    """Names of a project file's autoloads."""
    return F.regexp_extract_all(project, F.lit(r'resource/name="(\w+)"'), F.lit(1))


def registered(name: Column, project: Column) -> Column:
    """Whether a project file has an autoload: first under its heading, or set to a path of the project."""
    quoted = F.concat(F.lit(r"\Q"), name, F.lit(r"\E"))
    return F.coalesce(F.regexp_like(project, F.concat(F.lit(r"\[autoload\]\s*"), quoted, F.lit(r"\s*="))) | F.regexp_like(project, F.concat(quoted, F.lit(r'\s*=\s*"res://'))), F.lit(False))


def binding_issues(script: Column, scene: Column) -> Column:
    """What is wrong with a script's binding to a scene: the script has a uid and the scene, which holds a script, has none."""
    bound = scene.rlike(r'script\s*=\s*ExtResource\(\s*"([\w_/]+)"\s*\)') | F.contains(scene, F.lit("script ="))
    lacks = bound & ~F.contains(scene, F.lit("uid://")) & F.contains(script, F.lit("uid://"))
    return F.when(lacks, F.array(F.lit("Scene missing UID reference for script."))).otherwise(F.array().cast("array<string>"))


def line_of(content: Column, literal: Column) -> Column:
    """Number of the first line that holds a literal, -1 if none does."""
    lines = F.split(content, "\n", -1)
    at = F.array_position(F.transform(lines, lambda x: F.contains(x, literal)), True)
    return F.when(at > 0, at).otherwise(-1).cast("int")


def features(query: Column, code: Column, fix: Column, path: Column, error: Column) -> Column:
    """Struct of what a feedback entry is learned by."""
    lines = lambda c: F.size(F.split(F.coalesce(c, F.lit("")), "\n", -1))
    text = F.lower(F.concat_ws(" ", F.coalesce(query, F.lit("")), F.coalesce(code, F.lit(""))))
    ext = F.regexp_extract(path, r"[^/.][^/]*(\.[^/.]+)$", 1)
    return F.struct(
        F.when(F.coalesce(path, F.lit("")) == "", "unknown").otherwise(ext).alias("file_extension"),
        F.coalesce(F.nullif(error, F.lit("")), F.lit("general")).alias("error_type"),
        F.length(F.coalesce(query, F.lit(""))).alias("query_length"),
        lines(code).alias("code_lines"),
        lines(fix).alias("fix_lines"),
        F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?<![\p{{L}}\p{{N}}_])(?:{KEYWORDS})(?![\p{{L}}\p{{N}}_])"), F.lit(0)))).alias("keywords"),
    )


def relevance(query: Column, code: Column, kind: Column) -> Column:
    """Share of the question's words and of the code terms that a chunk holds; more for a function where the question
    says optimize, else for an error where it says fix; 1 at most."""
    low, text = F.lower(query), F.lower(code)
    words = F.array_distinct(F.concat(F.filter(F.split(low, r"\s+"), lambda w: w != ""), F.array(*map(F.lit, CODE_TERMS))))
    share = F.size(F.filter(words, lambda w: F.contains(text, w))) / F.size(words)
    boost = F.when(F.contains(low, F.lit("optimize")) & (kind == "function"), 0.2).when(F.contains(low, F.lit("fix")) & F.contains(text, F.lit("error")), 0.3).otherwise(0.0)
    return F.least(F.lit(1.0), share + boost)
