"""Sharding by jump consistent hashing: a key's shard follows from the key and the shard count.

No ring table is kept; with one more shard, keys move only into the new one. Built-in
expressions only. Null keys are keys of their own, all in one shard; null texts have size 1.
Repeated rows go to the same shard and take a slot each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tieweave.session import cut

# The published generator: next = key * MULTIPLIER + 1 (mod 2^64), and the constants it is used with.
MULTIPLIER = 2862933555777941757
_LOW = 0xFFFFFFFF


def _halves(digest: Column) -> Column:
    """First 64 bits of a hexadecimal digest as two unsigned 32-bit halves."""
    def part(at: int) -> Column:
        return F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    return F.struct(part(1).alias("hi"), part(9).alias("lo"))


def _step(hi: Column, lo: Column) -> tuple[Column, Column]:
    """One step of the generator on 32-bit halves: limb products never leave 64 bits."""
    m = [(MULTIPLIER >> (16 * k)) & 0xFFFF for k in range(4)]
    low16 = F.lit(0xFFFF)
    middle = lo * m[1]
    low = lo * m[0] + F.shiftleft(middle.bitwiseAND(low16), 16) + 1
    high = (
        F.shiftright(low, 32) + F.shiftright(middle, 16) + lo * m[2] + F.shiftleft((lo * m[3]).bitwiseAND(low16), 16)
        + hi * m[0] + F.shiftleft((hi * m[1]).bitwiseAND(low16), 16)
    )
    return high.bitwiseAND(F.lit(_LOW)), low.bitwiseAND(F.lit(_LOW))


def jump_hash(key: Column, shards: int) -> Column:
    """Shard of ``key`` (any type; hashed by its text form) among ``shards``.

    The loop ends after ``shards`` steps at most, since every step moves on by one or more.
    """
    start = F.struct(F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("j"), _halves(F.md5(F.coalesce(key.cast("string"), F.lit("")))).alias("k"))

    def move(s: Column, _: Column) -> Column:
        hi, lo = _step(s["k"]["hi"], s["k"]["lo"])
        # Top 31 bits of the key are the upper half without its lowest bit.
        to = F.floor((s["j"] + 1) * (F.lit(2147483648.0) / (F.shiftright(hi, 1) + 1).cast("double"))).cast("long")
        moved = F.struct(s["j"].alias("b"), to.alias("j"), F.struct(hi.alias("hi"), lo.alias("lo")).alias("k"))
        return F.when(s["j"] < shards, moved).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, move, lambda s: s["b"]).cast("int")


def slots(df: DataFrame, shard: str, order: list[str], out: str = "slot") -> DataFrame:
    """Gapless numbers from 0 in every shard, in the order of ``order``.

    Rows are range partitioned by shard and order, so that a large shard covers many tasks;
    a row's number is its place in its partition plus the rows of its shard in those before.
    """
    ranged = cut(
        df.repartitionByRange(F.col(shard), *[F.col(c) for c in order]).sortWithinPartitions(shard, *order)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", 33))
    )
    sizes = ranged.groupBy(shard, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(shard, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    # One row per shard and partition, a few bytes each.
    return ranged.join(F.broadcast(shift), [shard, "_part"]).withColumn(out, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def sharded(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size (UTF-8 bytes and 1), text_crc32, law, shard, slot, grown_shard (with one shard more)."""
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(
        F.col(key),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_hash(F.col(key), shards).alias("shard"),
        jump_hash(F.col(key), shards + 1).alias("grown_shard"),
    )
    return slots(narrow, "shard", [key, "text_crc32", "size"])
