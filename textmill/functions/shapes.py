"""Taking texts apart and putting them into shape: code in answers, bullets, caps, headers, lenient JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a line of code begins with, what an insight is marked by, how a cut is shown.
CODE_STARTS = ["func", "var", "if", "for", "class", "@export", "@onready", "extends"]
INSIGHTS = ["Issue:", "Problem:", "Recommendation:", "Suggestion:"]
CUT = "\n# [OUTPUT TRUNCATED: max lines reached]"
FENCE_GD, FENCE = r"(?is)```gdscript(.*?)```", r"(?s)```(.*?)```"
FENCED_BLOCK, INDENTED = r"(?s)```(?:\w+)?\n(.*?)```", r"(?m)^(    .*)$"
BULLET, SENTENCE = r"(?m)^(?:[-*•]|\d+\.)[ \t]+(.+)$", r"[.!?]\s+"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def code_blocks(text: Column) -> Column:
    """Fenced blocks, then lines indented by four spaces."""
    return F.concat(F.regexp_extract_all(text, F.lit(FENCED_BLOCK), 1), F.regexp_extract_all(text, F.lit(INDENTED), 1))


def code_of(text: Column, most_lines: int = 40, most_chars: int = 500) -> Column:
    """The code in an answer: the first script fence, else the first fence, else up to ``most_lines`` lines
    that look like code, else the beginning of the text. Null or blank text: empty."""
    begins = lambda x: F.greatest(*[F.ltrim(x).startswith(k) for k in CODE_STARTS], F.contains(x, F.lit("=")))
    looks = F.filter(_lines(text), begins)
    return (
        F.when(text.isNull() | ~text.rlike(r"\S"), "")
        .when(text.rlike(FENCE_GD), _stripped(F.regexp_extract(text, FENCE_GD, 1)))
        .when(text.rlike(FENCE), _stripped(F.regexp_extract(text, FENCE, 1)))
        .when(F.size(looks) > 0, _stripped(F.array_join(F.slice(looks, 1, most_lines), "\n")))
        .otherwise(F.substring(text, 1, most_chars))
    )


def bullets(text: Column, most: int = 5) -> Column:
    """Bullet points; where there are none, sentences of over 20 characters that don't begin with #."""
    found = F.regexp_extract_all(text, F.lit(BULLET), 1)
    sentences = F.filter(F.split(text, SENTENCE), lambda s: (F.length(_stripped(s)) > 20) & ~s.startswith("#"))
    return F.slice(F.when(F.size(found) > 0, found).otherwise(F.transform(sentences, _stripped)), 1, most)


def summary(text: Column, most: int = 100) -> Column:
    first = F.split(text, SENTENCE)[0]
    return F.when(F.length(first) > most, F.concat(F.substring(first, 1, most - 3), F.lit("..."))).otherwise(first)


def capped_lines(text: Column, most: int = 30) -> Column:
    """The first lines, with a mark where lines were cut. A line end at the end begins no line."""
    lines = _lines(F.regexp_replace(text, r"\n\z", ""))
    return F.when(F.size(lines) > most, F.concat(F.array_join(F.slice(lines, 1, most), "\n"), F.lit(CUT))).otherwise(text)


def chunk_context(source: Column, kind: Column, start: Column, end: Column, node_type: Column, parent: Column, content: Column) -> Column:
    """A chunk with its header: lines only from a start over 0, type and parent only where known."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("# Source: "), source, F.lit(" ("), kind, F.lit(")")),
        F.when(start > 0, F.concat(F.lit("# Lines: "), start, F.lit("-"), end)),
        F.concat(F.lit("# Type: "), node_type),
        F.concat(F.lit("# Parent: "), parent),
        F.lit(""),
        content,
    )


def analysis_lines(text: Column) -> dict[str, Column]:
    """How many lines speak of issues and recommendations, and the lines that carry a mark."""
    n = lambda w: F.size(F.filter(_lines(F.lower(text)), lambda x: F.contains(x, F.lit(w))))
    marked = F.filter(_lines(text), lambda x: F.greatest(*[F.contains(x, F.lit(m)) for m in INSIGHTS]))
    return {"issues": n("issue"), "recommendations": n("recommend"), "insights": F.transform(marked, _stripped)}


def first_braces(text: Column) -> Column:
    """From the first { whose braces close to where they do; null if none does. Braces are counted as characters, in one fold:
    each depth's open brace is kept on a stack, and of the closed stretches that none encloses the first is taken."""
    chars = F.split(text, "")
    state = F.struct(F.array().cast("array<int>").alias("open"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("i"))

    def step(s: Column, c: Column) -> Column:
        i, closes = s["i"] + 1, (c == "}") & (F.size(s["open"]) > 0)
        start = F.element_at(s["open"], -1)
        # an earlier start wins; one that encloses what was found starts earlier too
        better = closes & ((s["a"] == 0) | (start < s["a"]))
        opened = F.when(c == "{", F.concat(s["open"], F.array(i))).when(closes, F.slice(s["open"], F.lit(1), F.size(s["open"]) - 1)).otherwise(s["open"])
        return F.struct(opened.alias("open"), F.when(better, start).otherwise(s["a"]).alias("a"), F.when(better, i).otherwise(s["b"]).alias("b"), i.alias("i"))

    found = F.aggregate(chars, state, step, lambda s: F.struct(s["a"], s["b"]))
    return F.transform(F.array(found), lambda f: F.when(f["a"] > 0, F.substring(text, f["a"], f["b"] - f["a"] + 1)))[0]


def is_json(text: Column) -> Column:
    """Strictly: nothing may stand after the value. The parser stops at a value's end, so the text is parsed as the one element of an
    array and as the one value of an object; what stands after it can't end both."""
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"a":'), text, F.lit("}"))).isNotNull()


def lenient_json(text: Column) -> Column:
    """JSON text out of an answer, as a string: the text itself if it is JSON, else the object of a fence or, without one, the first whose
    braces close, with commas before closing brackets dropped and None, True, False put right. Null where that isn't JSON."""
    fenced = F.regexp_extract(text, r"(?is)```(?:json)?\s*(\{.*?\})\s*```", 1)
    inner = F.when(fenced != "", fenced).otherwise(first_braces(text))
    for pattern, new in ((r",\s*([}\]])", "$1"), (r"\bNone\b", "null"), (r"\bTrue\b", "true"), (r"\bFalse\b", "false")):
        inner = F.regexp_replace(inner, pattern, new)
    return F.when(is_json(text), text).when(is_json(inner), inner)
