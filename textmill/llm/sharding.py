"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``2**ring_bits`` cells. Every shard stands on it with ``replicas`` virtual
nodes; a key hashes to a cell and belongs to the next virtual node clockwise. A shard takes
no more than its capacity; keys over it walk on clockwise to the next shard with room. The
walk is made on counts of keys per arc (bounded by the ring, not by the data), inside one
SQL expression; rows are then placed by their rank in their arc. Nothing but DataFrame
functions runs.

Law kept: ``rows`` - capacities add up to the number of rows, so counts differ by one at most.

Defined results: an empty table gives an empty result; a null text has size 1 and a null
checksum input of no bytes (crc32 0); a null id is placed by its text, so that many null ids
don't meet in one cell; repeated rows are rows of their own and tie arbitrarily among equals;
extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def ring_arcs(spark: SparkSession, n_shards: int, replicas: int, ring_bits: int) -> DataFrame:
    """Cells of the ring with the virtual node (arc) they belong to and that node's shard."""
    cells = 1 << ring_bits
    nodes = (
        spark.range(n_shards * replicas)
        .select((F.col("id") % n_shards).cast("int").alias("shard"), F.floor(F.col("id") / n_shards).alias("rep"))
        .select("shard", F.pmod(F.xxhash64(F.lit("node"), "shard", "rep"), F.lit(cells)).alias("cell"))
        .groupBy("cell")
        .agg(F.min("shard").alias("shard"))
    )
    ring = W.partitionBy(F.lit(0)).orderBy(F.desc("cell")).rowsBetween(W.unboundedPreceding, 0)
    placed = spark.range(cells).withColumnRenamed("id", "cell").join(F.broadcast(nodes), "cell", "left")
    ahead = placed.select("cell", F.last(F.when(F.col("shard").isNotNull(), F.struct(F.col("cell").alias("arc"), "shard")), True).over(ring).alias("own"))
    first = F.min_by(F.struct("cell", "shard"), "cell")
    wrapped = nodes.agg(first.alias("w"))
    return ahead.join(F.broadcast(wrapped)).select(
        "cell", F.coalesce(F.col("own.arc"), F.col("w.cell")).alias("arc"), F.coalesce(F.col("own.shard"), F.col("w.shard")).alias("shard")
    )


def _segments(arcs: DataFrame, n_shards: int) -> DataFrame:
    """arcs(arc, shard, n) -> pieces of arcs: ranks lo <= r < hi go to ``shard`` from ``slot0`` on.

    One row of at most ``n_shards * replicas`` arcs is folded; the state is the room left in
    each shard and the pieces given out."""
    row = arcs.agg(F.array_sort(F.collect_list(F.struct("arc", "shard", "n"))).alias("a"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    take = "greatest(least(x.n - w.done, cap[s] - w.used[s]), 0L)"
    return row.selectExpr(
        f"transform(sequence(0, {n_shards - 1}), s -> total div {n_shards} + if(s < total % {n_shards}, 1L, 0L)) as cap",
        """transform(a, (x, i) -> struct(x.arc as arc, x.n as n,
            array_distinct(concat(transform(slice(a, i + 1, size(a)), y -> y.shard), transform(a, y -> y.shard))) as walk)) as arcs""",
    ).selectExpr(
        f"""explode(aggregate(arcs,
            struct(transform(cap, c -> 0L) as used, cast(array() as array<struct<arc: bigint, lo: bigint, hi: bigint, shard: int, slot0: bigint>>) as out),
            (st, x) -> aggregate(x.walk,
                struct(st.used as used, cast(array() as array<struct<arc: bigint, lo: bigint, hi: bigint, shard: int, slot0: bigint>>) as out, 0L as done),
                (w, s) -> if(w.done >= x.n, w, struct(
                    transform(w.used, (u, k) -> if(k = s, u + {take}, u)) as used,
                    concat(w.out, array(struct(x.arc as arc, w.done as lo, w.done + {take} as hi, s as shard, w.used[s] as slot0))) as out,
                    w.done + {take} as done)),
                w -> struct(w.used as used, concat(st.out, filter(w.out, p -> p.hi > p.lo)) as out)),
            st -> st.out)) as p"""
    ).select("p.*")


def bounded_ring(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", replicas: int = 64, ring_bits: int = 16) -> DataFrame:
    """Shard and gapless slot of each row of ``docs``.

    Returns doc_id, size, text_crc32, shard, slot, home_shard (the ring's choice before
    overflow). Rows of a cell are ranked together: 2**ring_bits cells share all rows evenly."""
    spark, cells = docs.sparkSession, 1 << ring_bits
    doc_id, text = F.col(id_col), F.col(text_col)
    key = F.when(doc_id.isNull(), F.xxhash64(F.lit("text"), text)).otherwise(F.xxhash64(doc_id))
    cell = F.pmod(key, F.lit(cells)).alias("cell")
    ring = ring_arcs(spark, n_shards, replicas, ring_bits)
    counts = docs.select(cell).groupBy("cell").agg(F.count("*").alias("n"))
    held = ring.join(counts.hint("shuffle_hash"), "cell", "left").select("cell", "arc", "shard", F.coalesce("n", F.lit(0)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("arc").orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # cells of the arc that wraps around come in the order in which the walk meets them
    start = held.withColumn("at", F.pmod(F.col("cell") - F.col("arc") - 1, F.lit(cells)))
    offsets = start.select("cell", "arc", F.col("shard").alias("home_shard"), before.alias("offset"))
    pieces = _segments(held.groupBy("arc", "shard").agg(F.sum("n").alias("n")), n_shards)
    rows = docs.select(
        doc_id.alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        key.alias("key"),
        cell,
    )
    rank = F.row_number().over(W.partitionBy("cell").orderBy("key", "doc_id", "text_crc32", "size")) - 1
    ranked = rows.withColumn("r", rank.cast("long")).join(F.broadcast(offsets), "cell").withColumn("r", F.col("r") + F.col("offset"))
    # both broadcasts are bounded by the ring: 2**ring_bits cells, n_shards * (replicas + 1) pieces
    pieces = pieces.withColumnRenamed("arc", "p_arc")
    hit = ranked.join(F.broadcast(pieces), (F.col("arc") == F.col("p_arc")) & (F.col("r") >= F.col("lo")) & (F.col("r") < F.col("hi")))
    return hit.select("doc_id", "size", "text_crc32", F.col("shard").cast("int"), (F.col("slot0") + F.col("r") - F.col("lo")).alias("slot"), "home_shard")
