"""Sharding by jump consistent hashing: DataFrame functions only.

A document's key walks along an infinite sequence of shard counts at which it would move; the last of them below
the number of shards is its shard. No ring table is kept, and n + 1 shards move only what goes into the new one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import add64, mul64, numbered

#: Fixed value: the multiplier of the published jump consistent hash.
STEP = 2862933555777941757


def jump_shard(key: Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, of a bigint key.

    A key makes at most `shards` jumps (about ln(shards) on average), so the jumps fold over an array of that length
    and rest once the next jump leads past the end. A null key is shard null.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    start = F.struct(key.cast("long").alias("key"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def jump(s: Column, _: Column) -> Column:
        nxt = add64(mul64(s["key"], STEP), F.lit(1).cast("long"))
        j = (F.lit(2.0**31) / (F.shiftrightunsigned(nxt, 33) + 1)) * (s["j"] + 1)
        moved = F.struct(nxt.alias("key"), s["j"].alias("b"), F.floor(j).cast("long").alias("j"))
        return F.when(s["j"] < shards, moved).otherwise(s)

    steps = F.sequence(F.lit(1), F.lit(shards))
    return F.when(key.isNotNull(), F.aggregate(steps, start, jump, lambda s: s["b"].cast("int")))


def shard(df: DataFrame, shards: int, key: str = "doc_id") -> DataFrame:
    """df with `shard`, `slot` (its place there, gapless from 0, by key) and `grown_shard` (with one shard more).

    Rows of equal key share a shard and have adjoining slots; a null key has a null shard and a slot among such
    rows; an empty table gives none. df should be narrow: its rows are ordered by one range shuffle on (shard, key),
    in which a shard spreads over as many ranges as it needs, never over one task.
    """
    placed = df.withColumn("shard", jump_shard(F.col(key), shards))
    placed = numbered(placed, ["shard"], [key], "slot")
    return placed.withColumn("grown_shard", jump_shard(F.col(key), shards + 1))


def shard_documents(df: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 1; null text: 1), text_crc32, law, shard, slot, grown_shard of every row."""
    text = F.coalesce("text", F.lit(""))
    narrow = df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
    )
    return shard(narrow, shards).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard"
    )
