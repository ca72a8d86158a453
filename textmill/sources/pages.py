"""Pages to text: blocks of the tags that hold it, without scripts, menus and advertisements."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.tokens import normalised, without_noise

# Elements and marks of elements that hold no content.
DROPPED = {"script", "style", "nav", "header", "footer", "aside", "iframe"}
MARKS = ("ad", "banner", "promo", "sponsor", "cookie", "newsletter")
VOID = {"br", "img", "meta", "link", "input", "hr", "source", "area", "base", "col", "embed", "wbr"}
TAGS = ("h1", "h2", "h3", "p", "li", "pre")


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__()
        self.open: list[tuple[str, bool]] = []
        self.found: list[tuple[str, list[str]]] = []
        self.at: list[int] = []

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        marked = any(k in ("class", "id") and v and any(m in v.lower() for m in MARKS) for k, v in attrs)
        hidden = bool(self.open and self.open[-1][1]) or tag in DROPPED or marked
        self.open.append((tag, hidden))
        if tag in TAGS and not hidden:
            self.found.append((tag, []))
            self.at.append(len(self.found) - 1)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                for t, hidden in reversed(self.open[i:]):
                    if t in TAGS and not hidden and self.at:
                        self.at.pop()
                del self.open[i:]
                return

    def handle_data(self, data):
        if not (self.open and self.open[-1][1]):
            for i in self.at:
                self.found[i][1].append(data)


def blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, pos, tag, text): a row for each block, tag by tag in the order of the list. Parsing a
    page is the only step in Python; all later ones are expressions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, html in zip(batch["i"], batch["h"]):
                parser = _Blocks()
                parser.feed(html or "")
                order = sorted(range(len(parser.found)), key=lambda k: (TAGS.index(parser.found[k][0]), k))
                rows += [(i, pos, parser.found[k][0], " ".join(parser.found[k][1])) for pos, k in enumerate(order)]
            yield pd.DataFrame(rows, columns=["page_id", "pos", "tag", "text"])

    rows = pages.select(F.col(id_col).alias("i"), F.col(html_col).alias("h"))
    return rows.mapInPandas(run, "page_id long, pos int, tag string, text string")


def distilled(pages: DataFrame, least: int = 20, most: int = 100) -> DataFrame:
    """Clean text of each page: noise out, short and repeated blocks out, joined by blank lines."""
    text = normalised(F.regexp_replace(normalised(without_noise(F.col("text"))), r"[^\p{L}\p{N}_\s.,!?;:\-'\"()]+", " "))
    clean = blocks(pages).withColumn("text", text).filter(F.length("text") >= least)
    first = clean.groupBy("page_id", "text").agg(F.min("pos").alias("pos"))
    kept = first.withColumn("r", F.row_number().over(W.partitionBy("page_id").orderBy("pos"))).filter(F.col("r") <= most)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "text"))), lambda x: x.text), "\n\n")
    return kept.groupBy("page_id").agg(F.count("*").alias("blocks"), joined.alias("content"))
