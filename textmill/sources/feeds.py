"""RSS and Atom feeds that landed as XML: two dialects, one shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: what of either dialect is read; RSS 1.0 has its items beside the channel
ITEM = "struct<title: string, description: string, link: string>"
FEED = f"channel struct<title: string, item: array<{ITEM}>>, item array<{ITEM}>, title string, entry array<struct<title: string, summary: string, content: string, link: array<struct<_href: string, _rel: string>>>>"


def _shaped(items: Column, summary: str, link) -> Column:
    empty = lambda c: F.coalesce(c, F.lit(""))
    return F.transform(items, lambda x: F.struct(empty(x["title"]).alias("title"), empty(x[summary] if summary != "summary" else F.coalesce(x["summary"], x["content"])).alias("summary"), empty(link(x)).alias("link")))


def _atom_link(entry: Column) -> Column:
    """The alternate link, which may be unnamed, else the first."""
    own = F.filter(entry["link"], lambda k: F.coalesce(k["_rel"], F.lit("alternate")) == "alternate")
    return F.coalesce(F.get(own, F.lit(0))["_href"], F.get(entry["link"], F.lit(0))["_href"])


def entries(feeds: DataFrame, id_col: str = "feed_id", xml_col: str = "xml", most: int = 3) -> DataFrame:
    """(feed_id, place, title, link, topic, content) of the first ``most`` entries of each feed. Broken XML and feeds
    without entries have none; absent titles, links and summaries are empty; an absent feed title is Unknown."""
    x = F.from_xml(F.col(xml_col), FEED, {"mode": "PERMISSIVE"})
    rss = _shaped(F.coalesce("x.channel.item", "x.item"), "description", lambda i: i["link"])
    rows = feeds.select(F.col(id_col).alias("feed_id"), x.alias("x"))
    rows = rows.select("feed_id", F.coalesce("x.channel.title", "x.title", F.lit("Unknown")).alias("source"), F.coalesce(rss, _shaped(F.col("x.entry"), "summary", _atom_link)).alias("items"))
    e = rows.select("feed_id", "source", F.posexplode(F.slice("items", 1, most)).alias("place", "e"))
    content = F.concat(F.lit("Title: "), "e.title", F.lit("\nSource: "), "source", F.lit("\nURL: "), "e.link", F.lit("\n\nSummary: "), "e.summary")
    words = F.filter(F.split(F.col("e.title"), r"\s+"), lambda w: w != "")
    return e.select("feed_id", F.col("place").cast("long").alias("place"), "e.title", "e.link", F.lower(F.array_join(F.slice(words, 1, 3), " ")).alias("topic"), content.alias("content"))
