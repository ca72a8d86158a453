"""Folder, archive, Markdown, JSON and log readers."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import files

# Extensions that a project scan takes.
EXTENSIONS = ["gd", "tscn", "tres", "godot", "cfg", "json", "md", "txt", "cs", "shader", "gdshader"]
MOST_BYTES = 200_000
FILES = "path string, size long, ext string, type string"


def kind(ext: Column) -> Column:
    return (
        F.when(ext.isin("gd", "cs"), "script").when(ext == "tscn", "scene").when(ext == "tres", "resource")
        .when(ext.isin("shader", "gdshader"), "shader").when(ext.isin("md", "txt"), "text").otherwise("other")
    )


def folder(spark: SparkSession, path: str, extensions: list[str] | None = None) -> DataFrame:
    """Metadata of a folder's files; contents aren't read. The size test reaches the scan."""
    glob = "*.{" + ",".join(extensions or EXTENSIONS) + "}"
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    ext = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))
    return df.filter(F.col("length") <= MOST_BYTES).select("path", F.col("length").alias("size"), ext.alias("ext"), kind(ext).alias("type"))


def texts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, content) of whole text files."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def archives(spark: SparkSession, path: str, strip_top: bool = False) -> DataFrame:
    """(archive, path, size, content) of the members of zip files, with the folder scan's tests. With ``strip_top`` the first
    member's folder goes where all members in folders share it. Broken archives have no members."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, data in zip(batch["path"], batch["content"]):
                try:
                    opened = zipfile.ZipFile(io.BytesIO(data))
                except zipfile.BadZipFile:
                    continue
                with opened as z:
                    names = z.namelist()
                    top = names[0].split("/")[0] + "/" if names else ""
                    strip = len(top) if strip_top and all(n.startswith(top) for n in names if "/" in n) else 0
                    for m in z.infolist():
                        if not m.is_dir() and m.filename.rsplit(".", 1)[-1].lower() in EXTENSIONS and m.file_size <= MOST_BYTES:
                            name = m.filename[strip:] if m.filename.startswith(top) else m.filename
                            yield pd.DataFrame({"archive": [archive], "path": [name], "size": [m.file_size], "content": [z.read(m).decode("utf-8", "replace")]})

    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return df.mapInPandas(members, "archive string, path string, size long, content string")


def knowledge(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, mode, topics, content) of Markdown files; mode and topics follow from the file's name."""
    stem = F.regexp_replace(F.regexp_extract("path", r"[^/]+$", 0), r"\.md$", "")
    return texts(spark, path, "*.md").select(stem.alias("file_id"), files.mode_of(stem).alias("mode"), files.topics_of(stem).alias("topics"), "content")


def front_matter(content: Column, key: str) -> Column:
    block = F.regexp_extract(content, r"(?s)\A---\n(.*?)\n---", 1)
    return F.nullif(F.trim(F.regexp_extract(block, rf"(?m)^{key}:(.*)$", 1)), F.lit(""))


def conversation_log(spark: SparkSession, path: str) -> DataFrame:
    """query and intent of JSON lines, from the first of their names that isn't empty; bad lines go."""
    names = ["query", "user_input", "input", "intent", "classification"]
    df = spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).option("mode", "DROPMALFORMED").json(path)
    first = lambda cs: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs])
    return df.select(first(names[:3]).alias("query"), first(names[3:]).alias("intent")).filter("query is not null")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """[ts] [LEVEL] message"""
    return parsed_log(spark.read.text(path), F.col("value"))


def parsed_log(df: DataFrame, value: Column) -> DataFrame:
    part = lambda i: F.regexp_extract(value, r"^\[([^\]]+)\] \[(\w+)\] (.*)$", i)
    return df.select(F.try_to_timestamp(part(1), F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts"), part(2).alias("level"), part(3).alias("message"))


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array or object file; missing strings are empty."""
    df = spark.read.option("multiLine", True).schema(schema).json(path)
    return df.na.fill("")


def pattern_map(spark: SparkSession, path: str) -> DataFrame:
    """(category, place, keywords, success_count) of a JSON file that maps categories to lists of patterns; missing counts are 0."""
    kind = "map<string, array<struct<keywords: array<string>, success_count: bigint>>>"
    maps = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("m"))
    rows = maps.select(F.explode("m").alias("category", "patterns")).select("category", F.posexplode("patterns").alias("place", "p"))
    return rows.select("category", "place", F.coalesce("p.keywords", F.array().cast("array<string>")).alias("keywords"), F.coalesce("p.success_count", F.lit(0)).cast("long").alias("success_count"))


def performance(log: DataFrame) -> DataFrame:
    """The performance records of a structured log."""
    x = F.col("extra")
    rows = log.filter(x["metric_type"] == "performance")
    return rows.select("timestamp", "correlation_id", x["operation"].alias("operation"), F.expr("try_cast(extra['duration_ms'] AS double)").alias("duration_ms"), (x["success"] == "true").alias("success"))


def logged_events(log: DataFrame) -> DataFrame:
    """The event records of a structured log; what an event holds stays JSON."""
    x = F.col("extra")
    return log.filter(x["event_type"].isNotNull()).select("timestamp", "correlation_id", x["event_type"].alias("event_type"), x["event_data"].alias("event_data"))


def structured_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with fixed fields; everything else stays in a map."""
    df = spark.read.text(path)
    fixed = "timestamp string, level string, logger string, message string, correlation_id string"
    rest = F.from_json("value", T.MapType(T.StringType(), T.StringType()))
    named = F.from_json("value", fixed)
    return df.select(named.alias("f"), F.map_filter(rest, lambda k, v: ~k.isin([x.split()[0] for x in fixed.split(", ")])).alias("extra")).select("f.*", "extra")


def pruned(path: Column) -> Column:
    """Paths that a project's scan leaves out: '.godot' or 'imports' anywhere, or a folder .git, .godot or addons."""
    return path.contains(".godot") | path.contains("imports") | path.rlike(r"(^|/)(\.git|\.godot|addons)/")


def safe_path(path: Column) -> Column:
    """Whether a relative path stays under its root: no step up, and not absolute."""
    return ~path.startswith("/") & ~path.rlike(r"(^|/)\.\.(/|$)")
