"""Rule tables for short texts - intents, routes, error types - as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tokens import any_of, hits

# Patterns of the router's types, in order of preference.
ROUTES = {
    "coding_fix": [
        r"\b(error|bug|issue|problem|broken|fail|crash)\b",
        r"\b(fix|repair|correct|resolve|debug)\b",
        r"\b(traceback|exception|assertion)\b",
        r":\s*error",
        r"not\s+defined",
        r"invalid\s+syntax",
    ],
    "coding_explain": [
        r"\b(how\s+to|how\s+do\s+i|how\s+can\s+i)\b",
        r"\b(implement|create|make|build|write)\b",
        r"\b(code|function|method|script|class)\b",
        r"\b(example|snippet|template)\b",
    ],
    "godot_specific": [
        r"\bgodot\b",
        r"\bgdscript\b",
        r"\b(node|scene|signal|slot|inspector)\b",
        r"\b(kinematic|rigid|area|collision)\b",
        r"\b(shader|material|texture|mesh)\b",
        r"\b(tween|animation|state_machine)\b",
        r"res://",
        r"func\s+_ready",
        r"extends\s+",
    ],
    "math_logic": [
        r"\b(calculate|compute|solve|evaluate)\b",
        r"\b(math|mathematics|algebra|calculus|geometry)\b",
        r"\b(equation|formula|theorem|proof)\b",
        r"\b(logic|boolean|truth|false)\b",
        r"[+\-*/]=",
        r"\d+\s*[+\-*/]\s*\d+",
    ],
    "comparison": [
        r"\b(compare|comparison|difference)\b",
        r"\b(vs|versus|rather\s+than|instead\s+of)\b",
        r"\b(better|worse|faster|slower|more\s+efficient)\b",
        r"\b(pros|cons|advantage|disadvantage)\b",
    ],
    "explanation": [
        r"\b(explain|describe|define|clarify)\b",
        r"\b(what\s+is|what\s+are|who\s+is|when\s+to)\b",
        r"\b(how\s+does|why\s+does|why\s+is)\b",
        r"\b(concept|meaning|purpose|reason)\b",
    ],
    "general_question": [
        r"\?$",
        r"\b(can\s+you|could\s+you|will\s+you)\b",
        r"\b(tell\s+me|show\s+me|give\s+me)\b",
    ],
}
# Handlers of the types.
HANDLERS = {
    "coding_fix": "code_fixer",
    "coding_explain": "code_explainer",
    "godot_specific": "godot_specialist",
    "math_logic": "math_solver",
    "comparison": "comparator",
    "explanation": "explainer",
    "general_question": "general_assistant",
}
# Keywords of intents, in order of preference.
INTENTS = {
    "debug": ["fix", "bug", "error", "crash", "issue", "problem", "broken", "wrong", "fail", "exception", "traceback", "debug"],
    "explain": ["explain", "understand", "what", "how", "why", "concept", "theory", "meaning", "describe", "tell me about"],
    "create": ["create", "make", "generate", "write", "build", "new", "implement", "add", "code", "function", "class"],
    "optimize": ["optimize", "improve", "faster", "performance", "refactor", "efficient", "speed", "memory", "better"],
    "search": ["find", "search", "look", "locate", "where", "documentation", "reference", "example", "tutorial"],
}
# First-match tables; the first row with a word that stands in the text wins.
MODES = {
    "debug": ["fix", "bug", "error", "debug", "crash", "broken", "fail"],
    "build": ["build", "create", "make", "implement", "generate", "write", "add"],
    "analyze": ["analyze", "explain", "list", "find", "show", "what", "how", "why", "review", "check", "issues", "problems", "tell me", "describe", "look at", "read"],
}
COMPLEX = {
    "analyze": ["analyze", "review", "optimize", "improve", "refactor"],
    "debug": ["fix", "error", "bug", "broken", "crash", "debug"],
    "build": ["create", "make", "build", "implement", "write", "generate"],
}
ACTIONS = {
    "optimize": ["optimize", "improve", "refactor"],
    "debug": ["fix", "error", "bug", "broken"],
    "explain": ["explain", "what", "how"],
    "build": ["create", "make", "add"],
    "analyze": ["analyze", "check", "review"],
}
ERRORS = {
    "null_reference": ["null", "none", "nil", "undefined"],
    "type_mismatch": ["type", "expected", "got", "cannot convert"],
    "signal_error": ["signal", "connect", "emit"],
    "scene_error": ["scene", "node", "tree", "instance"],
    "syntax_error": ["syntax", "invalid", "unexpected token"],
}
QUESTIONS = {
    "coding": ["code", "function", "variable", "script", "gdscript", "python", "error", "bug", "fix", "implement", "method", "class"],
    "math_logic": ["calculate", "compute", "math", "equation", "formula", "prove", "logic", "theorem"],
    "explanation": ["explain", "what is", "how does", "why", "describe", "define", "concept", "meaning"],
    "comparison": ["compare", "difference", "vs", "versus", "better", "worse"],
}
EXPERTISE = {
    "advanced": ["optimize", "architecture", "pattern", "best practice", "advanced"],
    "beginner": ["how to", "what is", "help", "beginner", "new to"],
}
EFFORT = {"low": ["simple", "basic", "quick"], "high": ["advanced", "complex", "full-featured"]}
KINDS = {
    "debug": ["error", "bug", "broken", "crash", "fail", "fix", "exception", "traceback", "not working", "wrong"],
    "explain": ["what is", "how does", "why", "explain", "define", "meaning", "understand"],
    "create": ["create", "make", "build", "implement", "write", "generate", "add", "new"],
    "optimize": ["optimize", "improve", "refactor", "faster", "better", "efficient", "performance"],
    "analyze": ["analyze", "review", "check", "examine", "inspect"],
}
# What an issue is reduced to: words, focus, instruction, limit.
REDUCTIONS = [
    (["velocity", "movement"], "movement logic", "normalize velocity handling and ensure delta is applied correctly", "max 30 lines"),
    (["delta", "_process"], "_process function", "add delta parameter and use it for frame-independent movement", "max 20 lines"),
    (["signal", "connect"], "signal connections", "ensure signals are properly connected and disconnected", "max 25 lines"),
    (["variable", "unused"], "code cleanup", "remove unused variables and improve code organization", "max 20 lines"),
]
# Second list of domain words, topics that rule the domain out, words of programming.
DOMAIN_2 = [
    "godot", "gdscript", "scene", "node", "shader", "tscn",
    "gdextension", "engine", "characterbody", "area2d", "area3d",
    "kinematic", "rigidbody", "sprite", "texture", "viewport",
    "signal", "export", "@export", "@onready", "_ready", "_process",
    "_physics_process", "func ", "var ", "extends ", "class_name",
    "instancerate", "preload", "load(", "get_node", "$", "yield",
    "await ", " tween", "animation", "collision", "hitbox", "hurtbox",
]
OFF_TOPIC = [
    "brownie", "banana", "recipe", "cooking", "baking",
    "python script", "django", "flask", "fastapi",
    "javascript", "react", "vue", "angular",
    "unity", "unreal", "game maker",
    "photoshop", "blender", "illustrator",
]
FAST = ["fast", "optimize", "performance", "efficient"]
CRITICAL = ["crash", "fatal", "critical", "urgent"]
STATUS = ["status", "health", "stats", "overview", "summary"]
EXPLAINING = ["what is ", "what are ", "explain ", "how does ", "define "]
CASUAL = ["hi", "hello", "hey", "yo", "thanks", "thank you", "congrats", "congratulations", "lol", "lmao", "haha", "how are you", "good morning", "good night", "nice", "cool"]
DOMAIN_ROUTE = ["godot", "gdscript", "scene", "node", "shader", "tscn", "gdextension", "engine", "export", "signal", " tween"]
DOMAIN = [
    "godot", "gdscript", "scene", "node", "shader", "tscn", "gdextension",
    "engine", "viewport", "canvas", "sprite", "kinematic", "rigidbody",
    "area", "collision", "signal", "tween", "animation", "material",
    "texture", "mesh", "light", "camera", "ui", "control", "panel",
    "button", "label", "lineedit", "vbox", "hbox", "grid", "margin",
    "color", "vector2", "vector3", "transform", "basis", "quat", "pool",
    "array", "dictionary", "yield", "await", "coroutine", "rpc", "network",
    "export", "onready", "class_name", "extends", "func", "var", "const",
    "enum", "tool", "editor", "inspector", "filesystem", "debugger",
]
STRONG = ["godot", "gdscript", "scene", "node", "shader", "tscn", "gdextension"]
TOPIC_STOP = ["how", "what", "why", "when", "where", "who", "can", "do", "does", "is", "are", "the", "a", "an", "to", "in", "for", "on", "with", "make", "create", "get", "use", "using"]
TEMPERATURES = [
    (["error", "bug", "broken", "crash", "fix"], 0.2, False),
    (["create", "make", "design", "implement", "new feature"], 0.75, True),
    (["explain", "what is", "how does", "why"], 0.45, False),
    (["analyze", "review", "optimize", "improve"], 0.5, False),
]


def first_match(text: Column, table: dict[str, list[str]], default: str) -> Column:
    out = None
    for name, words in table.items():
        out = (F if out is None else out).when(any_of(text, words), F.lit(name))
    return out.otherwise(F.lit(default))


def _best(scores: dict[str, Column], default: str) -> Column:
    """(name, score) of the largest score above 0; the first of equals."""
    n = len(scores)
    rows = F.array(*[F.struct(s.alias("score"), F.lit(n - i).alias("order"), F.lit(name).alias("name")) for i, (name, s) in enumerate(scores.items())])
    return F.array_max(F.array_append(rows, F.struct(F.lit(0).cast("double").alias("score"), F.lit(n + 1).alias("order"), F.lit(default).alias("name"))))


def route(text: Column) -> dict[str, Column]:
    """Type, confidence and matches of the pattern router."""
    scores, counts = {}, {}
    for name, patterns in ROUTES.items():
        counts[name] = sum((text.rlike("(?i)" + p).cast("int") for p in patterns), F.lit(0))
        boost = F.lit(1.0)
        if name == "godot_specific":
            boost = F.when(F.lower(text).contains("godot"), 1.5).otherwise(1.0)
        if name == "coding_fix":
            boost = F.when(any_of(text, ["error", "exception", "traceback"]), 1.3).otherwise(1.0)
        scores[name] = (counts[name] * boost).cast("double")
    best = _best(scores, "unknown")
    total = sum(map(len, ROUTES.values()))
    second = F.element_at(F.sort_array(F.array(*scores.values()), asc=False), 2)
    margin = F.when(best["name"] == "unknown", "none").when(best["score"] > second * 2, "high").when(best["score"] > second, "moderate").otherwise("open")
    return {"query_type": best["name"], "confidence": F.bround(F.least(F.lit(1.0), best["score"] / (total * 0.1)), 2), "margin": margin}


def handler(query_type: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in HANDLERS.items() for x in kv])[query_type], F.lit("general_assistant"))


def intent(text: Column) -> dict[str, Column]:
    """Keyword intent: under two hits it is general."""
    best = _best({k: hits(text, w).cast("double") for k, w in INTENTS.items()}, "general")
    sure = best["score"] >= 2
    return {"intent": F.when(sure, best["name"]).otherwise("general"), "confidence": F.when(sure, F.least(F.lit(0.7), F.bround(best["score"] * 0.2, 2))).otherwise(0.1)}


def fast_intent(text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(low.rlike("^(hi|hello|hey|good morning|good afternoon|good evening)"), "greeting")
        .when(any_of(text, STATUS), "status")
        .when(low.rlike("^(help|what can you do|how do i use|commands)"), "quick_help")
        .when(any_of(text, EXPLAINING), "explain")
        .otherwise("chat")
    )


def casual(text: Column) -> Column:
    low = F.trim(text)
    short = F.length(low) < 6
    work = any_of(low, ["fix", "bug", "error"]) | any_of(low, ["explain", "what", "how"])
    asks = any_of(low, ["fix", "bug", "error", "debug"]) | any_of(low, ["explain", "what", "how", "analyze", "why", "list", "find", "issues"])
    return F.when(short, ~work).otherwise(~asks & any_of(low, CASUAL))


def temperature(text: Column, intent_: Column, turns: Column) -> dict[str, Column]:
    """Sampling temperature, and whether to draw several samples."""
    kinds = [["debug", "fix"], ["build", "create"], ["explain"], ["analyze"]]
    t = n = None
    for (words, heat, many), own in zip(TEMPERATURES, kinds):
        test = intent_.isin(own) | any_of(text, words)
        t, n = (F if t is None else t).when(test, heat), (F if n is None else n).when(test, many)
    deep = (intent_ == "chat") & (turns > 3)
    return {"temperature": t.when(deep, 0.65).otherwise(0.5), "samples": n.otherwise(deep)}


def in_domain(text: Column, confidence: Column | None = None) -> Column:
    """A strong word or two domain words are enough, none is too few; with exactly one a classifier's
    ``confidence`` of 0.3 decides where there is a classifier, and it is enough where there is none."""
    n = hits(text, DOMAIN)
    one = confidence >= 0.3 if confidence is not None else F.lit(True)
    return any_of(text, STRONG) | (n >= 2) | ((n == 1) & one)


def in_domain_strictly(text: Column) -> Column:
    """An off-topic word rules the domain out unless it is named; else one domain word is enough."""
    return ~(any_of(text, OFF_TOPIC) & ~any_of(text, ["godot", "gdscript"])) & (hits(text, DOMAIN_2) > 0)


def kind(text: Column) -> dict[str, Column]:
    """The class with most words in the text, and a third of their number as confidence."""
    best = _best({k: hits(text, w).cast("double") for k, w in KINDS.items()}, "general")
    return {"kind": best["name"], "confidence": F.round(F.least(best["score"] / 3, F.lit(1.0)), 4)}


def reduced(text: Column) -> Column:
    """focus, instruction and limit of the first row whose words stand in the text."""
    out = None
    for words, *fields in REDUCTIONS:
        out = (F if out is None else out).when(any_of(text, words), F.array(*map(F.lit, fields)))
    return out


def topic_word(text: Column) -> Column:
    """The first word longer than 3 that is no question word."""
    words = F.filter(F.split(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), " "), lambda w: (F.length(w) > 3) & ~w.isin(TOPIC_STOP))
    return F.when(F.size(words) > 0, words[0]).otherwise("that topic")


# Patterns of the second set of fast intents, in order; the last only for short texts.
FAST_2 = {
    "greeting": [r"^\s*(hi|hello|hey|yo|hola|greetings)\b", r"^\s*(good\s+(morning|afternoon|evening|night))\b", r"^\s*(how\s+are\s+you|whats?\s*up|sup|yo)\b"],
    "status": [r"^\s*(status|stats)\b", r"\bhow\s+(many|much)\s+(scripts|scenes|files)\b", r"\bcount\s+(scripts|scenes|files)\b"],
    "quick_help": [r"^(help|what\s+can\s+you\s+do|commands|features)\b", r"^\s*thanks?\b", r"^(bye|goodbye|see\s+you|later)\b"],
    "explain": [r"^(what\s+is|define|explain)\s+", r"\s+mean(ing)?\s*[?]?\s*$"],
}
# Words of the file-aware intents.
FILE_DEBUG = ["fix", "bug", "error", "debug", "crash", "broken", "fail", "exception"]
FILE_BUILD = ["create", "make", "implement", "generate", "write", "add", "build", "new"]
FILE_CHANGE = ["optimize", "improve", "refactor", "clean", "simplify"]
FILE_ANALYZE = ["analyze", "list", "find", "show", "review", "check", "issues", "problems", "describe", "what do you think", "how is my", "rate my", "feedback on"]
FILE_NAME = r"([\w\-]+\.gd)"
# What a task is reduced to by its action, where no issue decides: focus, instruction, limit.
BY_ACTION = {
    "optimize": ("code structure", "reduce redundancy, improve readability, and apply Godot best practices", "max 25 lines"),
    "debug": ("bug fix", "identify and fix the root cause of the reported issue", "max 30 lines"),
    "build": ("new feature", "implement the requested functionality following Godot conventions", "max 30 lines"),
}


def fast_intent_by_patterns(text: Column, short: int = 60) -> Column:
    """The first set with a pattern in the trimmed text; explanations only of texts under ``short``; else complex."""
    t, out = F.trim(text), None
    for name, patterns in FAST_2.items():
        test = F.greatest(*[t.rlike("(?i)" + p) for p in patterns])
        test = test & (F.length(t) < short) if name == "explain" else test
        out = (F if out is None else out).when(test, name)
    return out.otherwise("complex")


def file_name(text: Column) -> Column:
    """The first script name in a text, null if there is none."""
    return F.nullif(F.regexp_extract(F.lower(text), FILE_NAME, 1), F.lit(""))


def file_aware_intent(text: Column) -> Column:
    """debug, build, then changes and analyses, which are a generation where the text names a file."""
    named = file_name(text).isNotNull()
    return (
        F.when(any_of(text, FILE_DEBUG), "debug").when(any_of(text, FILE_BUILD), "build")
        .when(named & any_of(text, FILE_CHANGE + FILE_ANALYZE), "generate")
        .when(any_of(text, FILE_ANALYZE), "analyze").otherwise("chat")
    )


def reduced_task(issues: Column, action: Column) -> Column:
    """Struct of focus, instruction and limit: by the issues' words, else by the action; null if neither decides."""
    row = lambda fields: F.struct(*[F.lit(v).alias(k) for k, v in zip(("focus", "instruction", "limit"), fields)])
    out = None
    for words, *fields in REDUCTIONS:
        out = (F if out is None else out).when(any_of(issues, words), row(fields))
    for name, fields in BY_ACTION.items():
        out = out.when(action == name, row(fields))
    return out


def response_style(level: Column, heat: Column) -> Column:
    """Struct of style, detail and tone from expertise and temperature."""
    return F.struct(
        F.when(level == "beginner", "educational").when(level == "advanced", "concise").otherwise("balanced").alias("style"),
        F.when(level == "beginner", "high").when(level == "advanced", "low").otherwise("medium").alias("detail"),
        F.when(heat > 0.7, "creative").when(heat < 0.3, "precise").otherwise("balanced").alias("tone"),
    )
