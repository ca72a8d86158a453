"""Licence scan by diagonal voting.

All rolling word k-gram hashes of the documents are joined with the positions of the same
k-grams in a small table of templates; each hit votes for the diagonal (place in the document
minus place in the template); neighbouring diagonals are merged into spans; spans are verified.
Hashes only find candidates: the k-gram's words are compared in the join, so a diagonal on
which every k-gram of a template stands is that phrase, word for word.

Three kinds of template: phrases, which count where they stand in full; notices (sentences) and
licences (whole texts, files of ``licence_texts``, labelled by what stands before the first dot of
their names), which give their label where the merged span covers ``min_cover`` of their k-grams;
of those of one kind that begin within ``TOGETHER`` words of each other only the best covered count.
Phrases and notices go by k-grams of ``k`` words, licences by ``long_k``, as pairs of frequent
words would meet them everywhere. All are constants, so the template side is broadcast at a fixed
size, and its hashes are a set of literals that leaves out other k-grams before the explode.

Defined results: a null or empty text has no words, no label and score 0; a null id is an id
like any other; repeated rows get equal results; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ._text import LOWER, UPPER, ascii_lower, row_key

TOGETHER = 40  # words

# Phrases that name a licence, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Sentences of public licence notices, and labels.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0": "apache",
    "you may not use this file except in compliance with the license": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license": "lgpl",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl",
}


def words(text: Column) -> Column:
    cut = F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.filter(cut, lambda w: w != "")


def licence_texts() -> list[tuple[str, str]]:
    """(label, words of the whole text); lines that name a holder of rights are left out."""
    out = []
    for file in sorted(Path(__file__).with_name("licence_texts").glob("*.txt")):
        text = re.sub(r"(?m)^\s*Copyright\b.*$", "", file.read_text(encoding="utf-8"))
        text = text.translate(str.maketrans(UPPER, LOWER))
        out.append((file.name.split(".")[0], " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text))))
    return out


def template_values(k: int, long_k: int, drift: int) -> str:
    """SQL rows (tid, kind, label, k, drift, text). Diagonals of a whole licence may lie an eighth of its length apart."""
    rows = [("phrase", label, k, drift, text) for text, label in PHRASES.items()]
    rows += [("notice", label, k, drift, text) for text, label in NOTICES.items()]
    rows += [("licence", label, long_k, max(drift, len(text.split()) // 8), text) for label, text in licence_texts()]
    quote = "'"
    return ", ".join(f"({tid}, '{kind}', '{label}', {n}, {far}, '{text.replace(quote, quote * 2)}')" for tid, (kind, label, n, far, text) in enumerate(rows))


def _hash(k: int) -> str:
    return f"xxhash64({', '.join(f'get(w, i + {j})' for j in range(k))})"


def templates(spark: SparkSession, k: int, long_k: int, drift: int) -> DataFrame:
    """A row for each place of each template: tid, kind, label, grams, drift, tpos, gram, h."""
    gram = f"struct(i AS tpos, array_join(slice(w, i + 1, k), ' ') AS gram, IF(k = {k}, {_hash(k)}, {_hash(long_k)}) AS h)"
    return spark.sql(
        f"SELECT tid, kind, label, size(w) - k + 1 AS grams, drift, g.* FROM (SELECT *, explode(transform(sequence(0, size(w) - k), i -> {gram})) AS g "
        f"FROM (SELECT *, split(text, ' ') AS w FROM VALUES {template_values(k, long_k, drift)} AS t(tid, kind, label, k, drift, text)))"
    )


def scan(docs: DataFrame, k: int = 2, long_k: int = 5, min_cover: float = 0.6, drift: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score. ``drift``: how far apart diagonals of one span may be (inserted or lost words)."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("rk"), words(F.col(text_col)).alias("w"))
    known = templates(spark, k, long_k, drift)

    def found_of(n: int) -> str:
        places = f"IF(size(w) < {n}, CAST(array() AS array<int>), sequence(0, size(w) - {n}))"
        return f"transform(filter({places}, i -> {_hash(n)} IN ({hashes})), i -> struct(i AS pos, {_hash(n)} AS h, array_join(slice(w, i + 1, {n}), ' ') AS g))"

    hashes = ", ".join(f"{r.h}L" for r in known.select("h").distinct().collect())  # of the templates: a constant
    grams = base.select("rk", F.explode(F.expr(f"concat({found_of(k)}, {found_of(long_k)})")).alias("x")).select("rk", "x.*")
    hits = grams.join(F.broadcast(known), "h").filter(F.col("g") == F.col("gram"))
    keys = ["rk", "tid", "kind", "label", "grams"]
    diagonals = hits.groupBy(*keys, "drift", (F.col("pos") - F.col("tpos")).alias("diag")).agg(F.collect_set("tpos").alias("at"))  # as many as the template's k-grams at most
    diagonals = diagonals.filter((F.col("kind") == "phrase") | (F.size("at") > 1))  # a single common pair is no trace of a notice
    line = W.partitionBy("rk", "tid").orderBy("diag")
    far = F.coalesce((F.col("diag") - F.lag("diag").over(line) > F.col("drift")).cast("int"), F.lit(1))
    spans = diagonals.withColumn("new", far).withColumn("span", F.sum("new").over(line.rowsBetween(W.unboundedPreceding, 0)))
    # a template's places that the span covers, however many diagonals are merged: a set of its k-grams
    covered = F.size(F.array_distinct(F.flatten(F.collect_set("at")))) / F.first("grams")
    full = F.size("at") == F.col("grams")
    spans = spans.groupBy(*keys, "span").agg(
        covered.alias("cover"),
        F.sum(full.cast("long")).alias("places"),
        F.min(F.when(full, F.col("diag"))).alias("first"),
        F.max(F.when(full, F.col("diag"))).alias("last"),
        F.min("diag").alias("start"),
    )
    spans = spans.filter((F.col("places") > 0) | (F.col("cover") >= min_cover))
    # templates of one family share most of their words: of those that begin together the best covered stay
    near = W.partitionBy("rk", "kind").orderBy("start").rangeBetween(-TOGETHER, TOGETHER)
    spans = spans.withColumn("best", F.max("cover").over(near)).filter((F.col("kind") == "phrase") | (F.col("cover") == F.col("best")))
    phrase = (F.col("kind") == "phrase") & (F.col("places") > 0)
    named = phrase | ((F.col("kind") != "phrase") & (F.col("cover") >= min_cover))
    found = spans.groupBy("rk").agg(
        F.sum(F.when(phrase, F.col("places"))).alias("n_base"),
        F.min(F.when(phrase, F.col("first"))).alias("first_word"),
        F.max(F.when(phrase, F.col("last"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(phrase, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(named, F.col("label")))), ",").alias("labels"),
        F.max(F.when(named, F.least(F.col("cover"), F.lit(1.0)))).alias("score"),
    )
    out = base.select("doc_id", "rk", F.size("w").cast("long").alias("n_words")).hint("merge").join(found, "rk", "left")
    none = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long"), F.col("last_word").cast("long"),
        none("base_labels"), none("labels"), F.coalesce("score", F.lit(0.0)).cast("double").alias("score"),
    )
