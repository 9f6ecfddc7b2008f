"""Longest-processing-time sharding of groups that must stay together.

Groups (rows of equal text) are given out by falling size, each to the shard
with the least load so far, by a heap.  Groups of at least one ``1/BIG``-th of
a shard go out one by one: there are ``BIG`` times the number of shards of
them at most.  The rest is first gathered into ``BUNDLES`` bundles by a hash of the
group, which then go out like groups.  So the driver schedules a bounded list
at any size of the table, and as long as there are fewer groups than bundles
the schedule is (but for groups that meet in a bundle) that of the groups
themselves.  Loads end apart by about one bundle, unless one group alone is
larger than a fair share.

Cases: a null text has no bytes and goes with the empty texts; repeated rows
are rows of one group, with a slot each; an empty table gives no row.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Groups above a 1/BIG of a fair share are scheduled alone; bundles of the others; rows aimed at in a
#: block in which a shard's slots are numbered, and blocks of a shard at most.
BIG, BUNDLES, BLOCK_ROWS, BLOCKS = 64, 16_384, 100_000, 16_384


def schedule(sizes: list[tuple], shards: int) -> dict:
    """Key to shard for (key, size) pairs: largest first (ties by key) to the least-loaded shard (ties to the lowest)."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for key, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, s = heapq.heappop(heap)
        out[key] = s
        heapq.heappush(heap, (load + size, s))
    return out


def shard(docs: DataFrame, shards: int, overhead: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row; sizes of shards are near equal, rows of equal text stay together."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("grp")), "shard")
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    numbered = max(1, min(BLOCKS, -(-n // (shards * BLOCK_ROWS))))
    groups = rows.groupBy("grp").agg(F.sum("size").alias("size"), F.pmod(F.xxhash64("grp"), F.lit(BUNDLES)).cast("int").alias("bundle"))
    big = F.col("size") * (BIG * shards) > total
    alone = [(bytes(r[0]), r[1]) for r in groups.filter(big).select("grp", "size").collect()]  # fewer than BIG * shards
    bundled = groups.filter(~big).groupBy("bundle").agg(F.sum("size")).collect()  # at most BUNDLES
    placed = schedule([*(("g" + k.hex(), n) for k, n in alone), *((f"b{k:08d}", n) for k, n in bundled)], shards)
    spark = docs.sparkSession
    by_group = spark.createDataFrame([(bytearray(k), placed["g" + k.hex()]) for k, _ in alone], "grp binary, own int")
    by_bundle = spark.createDataFrame([(k, placed[f"b{k:08d}"]) for k, _ in bundled], "bundle int, common int")
    put = (
        rows.withColumn("bundle", F.pmod(F.xxhash64("grp"), F.lit(BUNDLES)).cast("int"))
        .join(F.broadcast(by_group), "grp", "left")
        .join(F.broadcast(by_bundle), "bundle", "left")
        .select("doc_id", "size", "text_crc32", "grp", F.coalesce("own", "common").alias("shard"), F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(numbered)).cast("int").alias("block"))
    )
    counts = sorted((r[0], r[1], r[2]) for r in put.groupBy("shard", "block").count().collect())  # at most shards * BLOCKS
    first, at, was = [], 0, None
    for s, b, n in counts:
        at = 0 if s != was else at
        first.append((s, b, at))
        at, was = at + n, s
    offsets = spark.createDataFrame(first, "shard int, block int, first long")
    within = Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "grp")
    return (
        put.withColumn("n", F.row_number().over(within))
        .join(F.broadcast(offsets), ["shard", "block"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("n") - 1).alias("slot"))
    )
