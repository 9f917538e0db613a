"""Folds that turn logs of rows into current state. Every fold is associative, so it
combines on the map side and gives the same state in batch and in a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tieweave.functions import values as V
from tieweave.functions.text import edge_key
from tieweave.schema import ATTRIBUTES

EDGE_KEY = ["network_id", "source_id", "target_id"]


def source_priority(c: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for name, rank in V.SOURCE_PRIORITY.items():
        out = out.when(c == name, F.lit(rank))
    return out.otherwise(F.lit(0))


def upsert_edges(writes: DataFrame, keep_seq: bool = False) -> DataFrame:
    """Latest write of the highest provenance per directed edge.

    ``seq`` orders the writes. A lower provenance never replaces a higher one and an
    equal one always does, which is the maximum of (priority, seq).
    """
    payload = [c for c in writes.columns if c not in EDGE_KEY and c != "seq"]
    best = F.max(F.struct(source_priority(F.col("source")).alias("p"), F.col("seq"), *payload)).alias("w")
    out = writes.groupBy(*EDGE_KEY).agg(best)
    cols = [F.col(f"w.{c}").alias(c) for c in payload]
    return out.select(*EDGE_KEY, *cols, *([F.col("w.seq").alias("seq")] if keep_seq else []))


def drop_ai_edges(edges: DataFrame) -> DataFrame:
    """Remove guessed edges before they are extracted anew."""
    return edges.filter(F.col("source") != "ai_inferred")


def undirected(edges: DataFrame) -> DataFrame:
    """One row per unordered pair; the latest stored direction wins."""
    payload = [c for c in edges.columns if c not in EDGE_KEY and c != "edge_id"]
    last = F.max(F.struct("edge_id", *payload)).alias("w")
    return (
        edges.groupBy(
            "network_id", F.least("source_id", "target_id").alias("low_id"), F.greatest("source_id", "target_id").alias("high_id")
        )
        .agg(last)
        .select("network_id", "low_id", "high_id", F.col("w.edge_id").alias("edge_id"), *[F.col(f"w.{c}").alias(c) for c in payload])
    )


def both_ways(pairs: DataFrame) -> DataFrame:
    """Each undirected pair as two rows ``from_id -> to_id``."""
    rest = [c for c in pairs.columns if c not in ("low_id", "high_id")]
    there = pairs.select(F.col("low_id").alias("from_id"), F.col("high_id").alias("to_id"), *rest)
    back = pairs.select(F.col("high_id").alias("from_id"), F.col("low_id").alias("to_id"), *rest)
    return there.unionByName(back)


def with_edge_key(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("edge_key", edge_key(F.col("low_id"), F.col("high_id")))


def pair_choice(rows: DataFrame, a: str, b: str, order: str, last: bool) -> DataFrame:
    """First or last mention of every unordered pair inside one batch."""
    pick = F.max if last else F.min
    rest = [c for c in rows.columns if c not in ("network_id", a, b, order)]
    return (
        rows.groupBy("network_id", F.least(a, b).alias("low_id"), F.greatest(a, b).alias("high_id"))
        .agg(pick(F.struct(order, *rest)).alias("w"))
        .select("network_id", "low_id", "high_id", F.col(f"w.{order}").alias(order), *[F.col(f"w.{c}").alias(c) for c in rest])
    )


def merge_people(rows: DataFrame) -> DataFrame:
    """Rows of one name add up: last given text wins, lists unite in order seen, the
    wishlist mark sticks.

    List items are reduced to their first occurrence before they are gathered, so a
    name with very many rows never builds one huge list of lists.
    """
    key = ["network_id", "name"]
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("seq", c)))[c].alias(c)
    scalars = rows.groupBy(*key).agg(
        F.min("seq").alias("first_seq"), last("bio"), last("notes"), F.bool_or("is_wishlist").alias("is_wishlist")
    )
    items = rows.select(
        *key, "seq",
        F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("list")) for k in ATTRIBUTES])).alias("a"),
    ).select(*key, "seq", "a.kind", F.posexplode("a.list").alias("at", "value"))
    first_seen = items.filter(F.col("value") != "").groupBy(*key, "kind", "value").agg(F.min(F.struct("seq", "at")).alias("o"))
    gather = lambda k: F.transform(
        F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct("o", "value")))), lambda x: x["value"]
    ).alias(k)
    lists = first_seen.groupBy(*key).agg(*[gather(k) for k in ATTRIBUTES])
    none = F.array().cast("array<string>")
    return scalars.join(lists, key, "left").select(
        *key, "first_seq", "bio", "notes", "is_wishlist", *[F.coalesce(k, none).alias(k) for k in ATTRIBUTES]
    )


def replace_people(rows: DataFrame) -> DataFrame:
    """The last row of a name replaces everything before it."""
    rest = [c for c in rows.columns if c not in ("network_id", "name", "seq")]
    return (
        rows.groupBy("network_id", "name")
        .agg(F.min("seq").alias("first_seq"), F.max(F.struct("seq", *rest)).alias("w"))
        .select("network_id", "name", "first_seq", *[F.col(f"w.{c}").alias(c) for c in rest])
    )
