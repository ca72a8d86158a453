"""Tokenisers and small text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that the term tokeniser drops.
STOPWORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been",
    "being", "have", "has", "had", "do", "does", "did", "will",
    "would", "could", "should", "may", "might", "must", "shall",
    "to", "of", "in", "for", "on", "with", "at", "by", "from",
    "as", "into", "through", "during", "before", "after", "above",
    "below", "between", "under", "again", "further", "then", "once",
]
# Phrases that page cleaning removes.
NOISE = [
    "click here", "subscribe", "newsletter", "advertisement",
    "related articles", "read more", "share this", "follow us",
    "copyright", "all rights reserved", "privacy policy",
    "terms of service", "cookie policy", "accept cookies",
    "sign up", "log in", "register", "download app",
    "sponsored", "promoted", "advertising", "buy now",
]
# Terms that a query's keywords are looked up in.
KEY_TERMS = [
    "performance", "optimize", "fast", "efficient", "memory",
    "clean", "readable", "maintain", "refactor", "simplify",
    "delta", "frame", "signal", "node", "scene",
]


def code_tokens(text: Column, numbers: bool = True) -> Column:
    """Identifiers and, for documents, numbers of the lower-cased text, longer than 2."""
    pattern = r"[a-zA-Z_][a-zA-Z0-9_]*" + (r"|[0-9]+" if numbers else "")
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(pattern), 0), lambda x: F.length(x) > 2)


def index_words(text: Column) -> Column:
    """ASCII words of 3 characters or more that no other letter adjoins."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}\p{M}_]+"), 0), lambda x: x.rlike("^[a-z_][a-z0-9_]{2,}$"))


def terms(text: Column) -> Column:
    """Words with the marks of code kept, longer than 2, without stopwords."""
    flat = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s.\-\[\]]", " ")
    return F.filter(F.split(F.trim(F.regexp_replace(flat, r"\s+", " ")), " "), lambda x: (F.length(x) > 2) & ~x.isin(STOPWORDS))


def identifiers(text: Column) -> Column:
    """Lower-cased runs that begin with an ASCII letter or an underscore, of 3 characters or more."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[a-zA-Z_][\p{L}\p{N}_]*"), 0), lambda x: F.length(x) >= 3)


def blank_split(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), " ")


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def without_noise(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)\b(" + "|".join(NOISE) + r")\b", "")


# Named and numbered entities; & comes last, so that what it makes is not read again.
ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&#x27;": "'", "&nbsp;": " ",
    "&ndash;": "-", "&mdash;": "-", "&hellip;": "...", "&amp;": "&",
}


def unescaped(text: Column) -> Column:
    """The entities of ``ENTITIES`` as characters, dashes and blanks as plain ones; others stay as they stand."""
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def plain_page(html: Column) -> Column:
    """Tags off, entities as characters, white space collapsed, noise out, 10 000 characters at most."""
    return F.substring(without_noise(normalised(unescaped(F.regexp_replace(html, "<[^>]+>", " ")))), 1, 10000)


def density(text: Column) -> Column:
    """Share of letters, digits and sentence marks."""
    return F.when(F.length(text) > 0, F.bround(F.length(F.regexp_replace(text, r"[^\p{L}\p{N}.!?]", "")) / F.length(text), 2)).otherwise(F.lit(0.0))


def key_terms(text: Column) -> Column:
    """Terms of the fixed list that the text holds, else its first five words."""
    found = F.filter(F.array(*map(F.lit, KEY_TERMS)), lambda k: F.contains(F.lower(text), k))
    return F.when(F.size(found) > 0, found).otherwise(F.slice(F.split(normalised(text), " "), 1, 5))


def hits(text: Column, words: list[str]) -> Column:
    """How many of the words stand in the lower-cased text, as substrings."""
    low = F.lower(text)
    return sum((low.contains(w).cast("int") for w in words), F.lit(0))


def any_of(text: Column, words: list[str]) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out
