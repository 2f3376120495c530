"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

The ring has 4096 places. Every shard owns `VNODES` virtual nodes, put on places by a hash of shard and number; a row
sits on the place that its key hashes to and belongs to the first virtual node at or after it. Shards have a capacity;
the capacities add up to the number of rows and differ by one at most, so the loads are bounded exactly (law `rows`).
Rows that meet a full shard go on clockwise to the next shard with room.

Only the counts of the 4096 places (a fixed number of rows) reach the driver, which walks the ring over them and cuts
each place's rows into ranges of ranks. A row's rank within its place comes from two levels: the counts of 256 parts of
a place, summed up, plus the row's number within its part. Equal rows are counted before the first shuffle and are
spread again afterwards, so no key, not even one with a third of all rows, gathers in one task.

Null text counts as no bytes; rows with equal (doc_id, text) are told apart by slot only. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointloom.llm.common import Scratch, table

PLACES, PARTS, VNODES, BLOCK = 4096, 256, 64, 65_536


def _hash(text: str) -> int:
    """64-bit FNV-1a with a finaliser, for the few virtual nodes."""
    x = 0xCBF29CE484222325
    for byte in text.encode():
        x = (x ^ byte) * 0x100000001B3 % 2**64
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD % 2**64
    return x ^ x >> 33


def ring(shards: int) -> list[list[int]]:
    """For every place, the shards of the virtual nodes on it."""
    places: list[list[int]] = [[] for _ in range(PLACES)]
    for shard in range(shards):
        for node in range(VNODES):
            places[_hash(f"{shard}/{node}") % PLACES].append(shard)
    return places


def walk(counts: dict[int, int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Ranges (place, first rank, end rank, shard, slot of the first rank).

    Going round: every place hands its own rows and those that earlier places could not seat to the virtual nodes on
    it, each takes what its shard has room for, and the rest goes on. Rows that came first are seated first. Two rounds
    seat every row, as the capacities add up to all rows and a whole round passes every shard.
    """
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    at, out, waiting = ring(shards), [], []
    for turn in range(3):
        for place in range(PLACES):
            if turn == 0 and counts.get(place):
                waiting.append([place, 0, counts[place]])
            for shard in at[place]:
                while waiting and used[shard] < room[shard]:
                    head = waiting[0]
                    n = min(head[2] - head[1], room[shard] - used[shard])
                    out.append((head[0], head[1], head[1] + n, shard, used[shard]))
                    used[shard] += n
                    head[1] += n
                    if head[1] == head[2]:
                        waiting.pop(0)
        if not waiting:
            break
    return out


def shard_rows(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, size, text_crc32, shard, slot), one for each row of `docs`."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    same = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    same = same.select("*", F.pmod(key, F.lit(PLACES)).cast("int").alias("place"), F.pmod(F.xxhash64(F.col("doc_id"), F.col("size"), F.col("text_crc32"), F.lit("part")), F.lit(PARTS)).cast("int").alias("part"))
    same = scratch.table(same, "same")
    parts = same.groupBy("place", "part").agg(F.sum("n").alias("rows"))
    parts = scratch.table(parts, "parts")  # 4096 x 256 rows at most
    counts = {r["place"]: r["rows"] for r in parts.groupBy("place").agg(F.sum("rows").alias("rows")).collect()}  # 4096 rows at most
    before = F.sum("rows").over(Window.partitionBy("place").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select("place", "part", F.coalesce(before, F.lit(0)).alias("start"))
    within = Window.partitionBy("place", "part").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    ranked = same.withColumn("ahead", F.coalesce(F.sum("n").over(within), F.lit(0))).join(starts, ["place", "part"])
    # copies of one row come apart in blocks first, so that a row with very many copies is dealt over tasks
    blocks = ranked.select("doc_id", "size", "text_crc32", "place", "n", (F.col("start") + F.col("ahead")).alias("rank"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(BLOCK).cast("long"))).alias("block"))
    copies = F.sequence(F.col("block"), F.least(F.col("n"), F.col("block") + BLOCK) - 1)
    each = blocks.select("doc_id", "size", "text_crc32", "place", "rank", F.explode(copies).alias("copy")).select("doc_id", "size", "text_crc32", "place", (F.col("rank") + F.col("copy")).alias("rank"))
    plan = walk(counts, shards) or [(-1, 0, 0, 0, 0)]
    ranges = ",".join(f"({p},{a}L,{b}L,{s},{t}L)" for p, a, b, s, t in plan)  # at most one per place and one per seat taken: a few thousand
    ranges = spark.sql(f"SELECT * FROM VALUES {ranges} AS t(place, lo, hi, shard, seat)")
    found = each.join(F.broadcast(ranges), "place").where("rank >= lo and rank < hi")
    return found.select("doc_id", "size", "text_crc32", "shard", (F.col("seat") + F.col("rank") - F.col("lo")).alias("slot"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard_rows(table(spark, sf_dir, "documents"), 16)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
