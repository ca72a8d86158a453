"""Scripts and scenes as tables of lines: chunks, blocks, bodies, scene rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def in_order():
    return W.partitionBy("path").orderBy("line_no")


def so_far():
    return in_order().rowsBetween(W.unboundedPreceding, 0)


def lines_of(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, line_no from 1, line)"""
    return files.select(F.col(path).alias("path"), F.posexplode(F.split(content, "\n", -1)).alias("p", "line")).select("path", (F.col("p") + 1).alias("line_no"), "line")


def files_of(lines: DataFrame) -> DataFrame:
    """(path, content): a file's lines put together again; as long as the file is."""
    return lines.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x.line), "\n").alias("content"))


def chunks(lines: DataFrame) -> DataFrame:
    """A new chunk at each class or func line; blank chunks are left out. Chunk 0 is what stands before."""
    head = F.col("line").rlike(r"^(class|func)\s")
    kind = F.regexp_extract("line", r"^(class|func)\s+([A-Za-z_]\w*)", 1)
    name = F.regexp_extract("line", r"^(class|func)\s+([A-Za-z_]\w*)", 2)
    numbered = lines.withColumn("chunk", F.sum(head.cast("int")).over(so_far())).withColumn("kind", F.when(head, kind)).withColumn("name", F.when(head, name))
    out = numbered.groupBy("path", "chunk").agg(
        F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"),
        F.max("kind").alias("kind"), F.max("name").alias("name"), F.max((F.trim(F.regexp_replace("line", r"\s", "")) != "").cast("int")).alias("full"),
    )
    return out.filter("full = 1").drop("full")


def strict_chunks(lines: DataFrame) -> DataFrame:
    """(path, chunk, class, function, start_line, end_line) as an index keeps them: what stands before a class line is kept only if a class is open,
    before a func line only if a function is; what stands at the end is kept. A chunk is labelled with what is open in it: a class ends the
    function before it. Blank chunks are left out."""
    line = F.regexp_replace("line", r"^\s+|\s+$", "")
    kind = F.when(line.startswith("class "), "class").when(line.startswith("func "), "func")
    named = F.when(kind == "class", F.regexp_extract(line, r"^class\s+([^\s:]*)", 1)).when(kind == "func", F.coalesce(F.nullif(F.regexp_extract(line, r"^func\s+([a-zA-Z_][a-zA-Z0-9_]*)", 1), F.lit("")), F.lit("unknown")))
    numbered = lines.withColumns({"kind": kind, "name": named, "full": (line != "").cast("int")}).withColumn("chunk", F.sum(F.col("kind").isNotNull().cast("int")).over(so_far()))
    parts = numbered.groupBy("path", "chunk").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.max("kind").alias("kind"), F.max("name").alias("name"), F.max("full").alias("full"))
    order = W.partitionBy("path").orderBy("chunk")
    opened = F.last(F.when(F.col("kind") == "class", F.col("name")), True).over(order.rowsBetween(W.unboundedPreceding, 0))
    parts = parts.withColumns({"class": opened, "function": F.when(F.col("kind") == "func", F.col("name")), "next": F.lead("kind").over(order)})
    kept = F.when(F.col("next") == "class", F.col("class").isNotNull()).when(F.col("next") == "func", F.col("function").isNotNull()).otherwise(True)
    return parts.filter(kept & (F.col("full") == 1)).select("path", "chunk", "class", "function", "start_line", "end_line")


def orphans(rows: DataFrame, dot_is_root_child: bool = True) -> DataFrame:
    """Scene rows -> (path, line_no) of the second and later nodes of a scene without a parent. Where a parent "." doesn't
    count as one, children of the root are among them."""
    alone = F.col("a_parent").isNull()
    nodes = rows.filter((F.col("section") == "node") & (alone if dot_is_root_child else alone | (F.col("a_parent") == ".")))
    return nodes.withColumn("r", F.row_number().over(W.partitionBy("path").orderBy("line_no"))).filter("r > 1").select("path", "line_no")


def scene_warnings(lines: DataFrame) -> DataFrame:
    """(path, line_no, warning) of the signal connections in scenes' lines."""
    pattern = r'\[connection signal="([^"]+)" from="([^"]+)" to="([^"]+)" method="([^"]+)"'
    part = lambda i: F.regexp_extract("line", pattern, i)
    text = F.concat(F.lit("Signal connection found: "), part(2), F.lit("."), part(1), F.lit(" -> "), part(3), F.lit("."), part(4))
    return lines.filter(F.col("line").rlike(pattern)).select("path", "line_no", text.alias("warning"))


def line_type(line: Column) -> Column:
    s = F.ltrim(line)
    return (
        F.when((s == "") | s.startswith("#"), F.lit(None).cast("string"))
        .when(s.startswith("class "), "class").when(s.startswith("func "), "function").when(s.startswith("signal "), "signal")
        .when(s.startswith("var ") | s.startswith("const "), "variable")
    )


def in_blocks(lines: DataFrame) -> DataFrame:
    """Each line with the number and the type of its block: a new one begins where a typed line's type differs from
    the current one; other lines join the current."""
    typed = lines.withColumn("t", line_type(F.col("line")))
    before = F.last("t", True).over(in_order().rowsBetween(W.unboundedPreceding, -1))
    new = F.when(F.col("t").isNotNull() & before.isNotNull() & (F.col("t") != before), 1).otherwise(0)
    return typed.withColumn("new", new).withColumn("block", F.sum("new").over(so_far())).drop("new")


def blocks(lines: DataFrame) -> DataFrame:
    return in_blocks(lines).groupBy("path", "block").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.max("t").alias("kind"))


def process_bodies(lines: DataFrame, most: int = 15) -> DataFrame:
    """Bodies of _process with more than ``most`` lines that are neither blank nor comments."""
    head = F.col("line").rlike(r"^\s*func\s+_process\s*\(")
    edge = head | F.col("line").rlike(r"^\s*func\s+\w+") | F.col("line").rlike(r"^[^ \t\s]")
    body = lines.withColumn("span", F.sum(edge.cast("int")).over(so_far())).withColumn("head", head)
    counted = (~edge & ~F.col("line").rlike(r"^\s*(#|$)")).cast("int")
    out = body.groupBy("path", "span").agg(F.max("head").alias("is_process"), F.min("line_no").alias("line_number"), F.sum(counted).alias("body_lines"))
    return out.filter(F.col("is_process") & (F.col("body_lines") > most)).select("path", "line_number", "body_lines")


def referred(line: Column) -> Column:
    """Array of (dst, kind) that a line extends, preloads and loads, project-relative."""
    return F.array_compact(
        F.array(
            *[
                F.when(line.rlike(p), F.struct(F.regexp_extract(line, p, 1).alias("dst"), F.lit(kind).alias("kind")))
                for p, kind in ((r'^extends "res://([^"]+)"', "extends"), (r'preload\("res://([^"]+)"\)', "preload"), (r'(?:^|[^e])load\("res://([^"]+)"\)', "load"))
            ]
        )
    )


def dependencies(lines: DataFrame) -> DataFrame:
    """(src, dst, kind) of extends, preload and load, project-relative."""
    return lines.select("path", F.explode(referred(F.col("line"))).alias("e")).select(F.col("path").alias("src"), "e.dst", "e.kind").distinct()


def scene_rows(lines: DataFrame) -> DataFrame:
    """Scene lines with the header they stand under: section, attributes of headers, key and value of properties."""
    header = F.col("line").startswith("[")
    attr = lambda a: F.when(header, F.nullif(F.regexp_extract("line", rf'\b{a}="([^"]*)"', 1), F.lit("")))
    out = lines.withColumn("head", F.when(header, F.col("line_no"))).withColumn("owner", F.last("head", True).over(so_far()))
    out = out.withColumn("section", F.when(header, F.regexp_extract("line", r"^\[(\w+)", 1)))
    for a in ("name", "type", "parent", "path", "id", "signal", "from", "to", "method"):
        out = out.withColumn(f"a_{a}", attr(a))
    prop = ~header & F.col("line").contains(" = ")
    return out.withColumn("key", F.when(prop, F.regexp_extract("line", r"^(\S+) = ", 1))).withColumn("value", F.when(prop, F.regexp_extract("line", r"^\S+ = (.*)$", 1)))


def broken_connections(rows: DataFrame) -> DataFrame:
    """(path, line_no, side, name) of connection ends that are neither a node of their scene, nor under one,
    nor the root ".". An end's own name and all names above it are met with the nodes in one equi-join."""
    nodes = rows.filter("section = 'node'").select("path", F.col("a_name").alias("above")).distinct()
    sides = F.explode(F.array(*[F.struct(F.lit(x).alias("side"), F.col(f"a_{x}").alias("name")) for x in ("from", "to")])).alias("e")
    ends = rows.filter("section = 'connection'").select("path", "line_no", sides).select("path", "line_no", "e.side", "e.name")
    ends = ends.filter((F.col("name") != ".") & ~F.col("name").startswith("./"))
    parts = F.split("name", "/")
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("above")
    held = ends.select("path", "line_no", "side", above).hint("merge").join(nodes, ["path", "above"], "left_semi").select("path", "line_no", "side").distinct()
    return ends.hint("merge").join(held, ["path", "line_no", "side"], "left_anti")
