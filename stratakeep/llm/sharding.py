"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of cells. A row's hash names its cell; virtual nodes sit at cell
borders, and a row belongs to the first virtual node at or after its cell. Shards hold a bounded
load: floor or ceiling of rows / shards. A row that meets a full shard continues clockwise to the
next virtual node whose shard has room, so counts end at most one apart, and only the overflow
moves away from its home shard.

Only counts per cell matter for that walk, and the number of cells is fixed. One distributed count
gives them; the walk itself runs over this fixed-size table while the plan is built and yields
segments (cell, first rank, last rank, shard, first slot). Rows are ranked inside their cell and meet
their segment in a broadcast join whose size is bounded by the ring and not by the data. A cell of more than
CELL_ROWS rows, as equal rows make one, is ranked in parts: counts of its parts give each part's first rank.
"""

from __future__ import annotations

import json
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, prefix_totals, table

RING_CELLS = 1 << 16
VIRTUAL_NODES = 256
#: Rows that are ranked in one group at most, or about that many.
CELL_ROWS = 1 << 20
_SEGMENT = "array<struct<seg_cell:int,lo:bigint,hi:bigint,shard:int,slot0:bigint>>"


def ring(spark: SparkSession, shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """Sorted (cell, shard) of the virtual nodes; a shard's nodes do not depend on how many shards there are."""
    node = spark.range(shards * virtual_nodes).select(
        F.pmod(F.xxhash64(F.lit("virtual node"), F.col("id") % shards, F.floor(F.col("id") / shards)), F.lit(RING_CELLS)).cast("int").alias("cell"), (F.col("id") % shards).cast("int").alias("shard")
    )
    return sorted((r.cell, r.shard) for r in node.collect())


def walk(counts: dict[int, int], nodes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Place the cells' rows clockwise under the load bound; returns (cell, lo, hi, shard, slot0), ranks from 1."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    live = list(nodes)
    out = []
    for cell in sorted(counts):
        rank, left = 1, counts[cell]
        at = bisect_left(live, (cell, -1))
        while left:
            _, shard = live[at % len(live)]
            take = min(left, room[shard])
            if take:
                out.append((cell, rank, rank + take - 1, shard, used[shard]))
                used[shard] += take
                room[shard] -= take
                rank += take
                left -= take
            if not room[shard]:  # full shards leave the ring, so each walk step is spent once
                live = [x for x in live if room[x[1]]]
                at = bisect_left(live, (cell, -1))
    return out


def _literal(spark: SparkSession, names: tuple[str, ...], rows: list[tuple], kind: str) -> DataFrame:
    """A small table that is part of the plan."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps([dict(zip(names, r)) for r in rows])), kind)).alias("_s")).select("_s.*")


def shard_rows(rows: DataFrame, key: list[str], shards: int = 16, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """Add ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard) to every row.

    ``key`` columns decide the place on the ring; null keys are keys like any other. Rows with
    equal keys share a cell and are told apart by rank, so repeats are placed too, however many. Empty input gives
    no rows.
    """
    spark = rows.sparkSession
    cell = F.pmod(F.xxhash64(*key), F.lit(RING_CELLS)).cast("int")
    placed = durable(rows.withColumn("_cell", cell).withColumn("_row", F.monotonically_increasing_id()), "sharding")
    counts = {r["_cell"]: r["n"] for r in placed.groupBy("_cell").agg(F.count("*").alias("n")).collect()}
    segments = walk(counts, ring(spark, shards, virtual_nodes), shards)
    segment = _literal(spark, ("seg_cell", "lo", "hi", "shard", "slot0"), segments, _SEGMENT).select("seg_cell", "lo", "hi", F.col("shard").alias("_shard"), "slot0")
    full = [(c, -(-n // CELL_ROWS)) for c, n in sorted(counts.items()) if n > CELL_ROWS]
    if full:  # at most one row a cell of the ring
        split = _literal(spark, ("_of", "_parts"), full, "array<struct<_of:int,_parts:bigint>>")
        placed = placed.join(F.broadcast(split), F.col("_cell") == F.col("_of"), "left")
        placed = placed.withColumn("_part", F.coalesce(F.pmod(F.xxhash64("_row"), "_parts"), F.lit(0).cast("long"))).drop("_of", "_parts")
        sizes = placed.where(F.col("_cell").isin([c for c, _ in full])).groupBy("_cell", "_part").agg(F.count("*").alias("_n"))
        before = prefix_totals(sizes, ["_cell"], "_part", "_n", "_before").select(F.col("_cell").alias("_c"), F.col("_part").alias("_p"), "_before")
        placed = placed.join(before, (F.col("_cell") == F.col("_c")) & (F.col("_part") == F.col("_p")), "left").withColumn("_before", F.coalesce("_before", F.lit(0).cast("long"))).drop("_c", "_p")
    else:
        placed = placed.withColumn("_part", F.lit(0)).withColumn("_before", F.lit(0))
    place = F.row_number().over(Window.partitionBy("_cell", "_part").orderBy(*key))
    ranked = placed.withColumn("_rank", (F.col("_before") + place).cast("long"))
    joined = ranked.join(F.broadcast(segment), (F.col("_cell") == F.col("seg_cell")) & F.col("_rank").between(F.col("lo"), F.col("hi")))
    return joined.select(*rows.columns, F.col("_shard").alias("shard"), (F.col("slot0") + F.col("_rank") - F.col("lo")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Shard documents under the ``rows`` law: counts of any two shards differ by one at most.

    Null text has size 1 and the checksum of no bytes; null and repeated ids, empty and very long
    texts are rows like any other; other columns are not read. The text is read once: its size and
    checksum go to a narrow durable table from which ring counts and ranks are taken.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("string")
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"))
    out = shard_rows(thin, ["doc_id", "text_crc32", "size"], shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op1_shard_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
