"""Retrieval quality. Everything stays in rows: retrieved (variant, query_id, item, rank)
and golden (query_id, kind, item), so lists of any length are fine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

KEY = ["variant", "query_id"]


def marked(retrieved: DataFrame, golden: DataFrame, kind: str) -> DataFrame:
    """Retrieved rows that are of the given golden kind."""
    return retrieved.join(golden.filter(F.col("kind") == kind).select("query_id", "item").distinct(), ["query_id", "item"], "left_semi")


def score_queries(retrieved: DataFrame, golden: DataFrame, queries: DataFrame, k: int = 5, ndcg_k: int = 10, depth: int = 5) -> DataFrame:
    """Recall@k, MRR, NDCG@ndcg_k and cliff hit of every variant and query.

    Only the first ``depth`` results are looked at. queries: query_id, category.
    """
    seen = retrieved.filter(F.col("rank") <= depth)
    hits = marked(seen, golden, "expected").groupBy(*KEY).agg(
        F.count_if(F.col("rank") <= k).alias("hits"),
        F.min("rank").alias("first"),
        F.sum(F.when(F.col("rank") <= ndcg_k, 1.0 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    cliffs = marked(seen, golden, "forbidden").filter(F.col("rank") <= k).select(*KEY).distinct().withColumn("cliff", F.lit(True))
    wanted = golden.filter("kind = 'expected'").groupBy("query_id").agg(F.count(F.lit(1)).alias("expected"))
    runs = retrieved.select(*KEY).distinct()
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("expected"), F.lit(ndcg_k).cast("long"))).cast("int")),
        F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1),
    )
    rows = runs.join(queries.select("query_id", "category"), "query_id").join(wanted, "query_id", "left").join(hits, KEY, "left").join(cliffs, KEY, "left")
    none = F.coalesce("expected", F.lit(0)) == 0
    return rows.select(
        *KEY, "category",
        F.when(none, 0.0).otherwise(F.coalesce("hits", F.lit(0)) / F.col("expected")).alias("recall"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.when(none, 0.0).otherwise(F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"),
        F.coalesce("cliff", F.lit(False)).alias("cliff_hit"),
    )


def summarise(scores: DataFrame) -> DataFrame:
    """Averages by variant and by (variant, category) in one pass; category is null for all."""
    return scores.groupingSets([["variant"], ["variant", "category"]], "variant", "category").agg(
        F.count(F.lit(1)).alias("n"), F.avg("recall").alias("recall"), F.avg("mrr").alias("mrr"), F.avg("ndcg").alias("ndcg"),
        (1.0 - F.count_if("cliff_hit") / F.count(F.lit(1))).alias("cliff_avoidance"),
    )


def compare_variants(scores: DataFrame, variants: list[str]) -> DataFrame:
    """One row per query with the metrics of every variant side by side."""
    return scores.groupBy("query_id", "category").pivot("variant", variants).agg(
        F.max("recall").alias("recall"), F.max("mrr").alias("mrr"), F.max("ndcg").alias("ndcg"), F.bool_or("cliff_hit").alias("cliff")
    )


def overlaps(retrieved: DataFrame, golden: DataFrame) -> DataFrame:
    """Retrieved items that are expected or forbidden: variant, query_id, kind, item."""
    return retrieved.join(golden.select("query_id", "kind", "item").distinct(), ["query_id", "item"]).select(*KEY, "kind", "item", "rank")


def golden_counts(queries: DataFrame) -> DataFrame:
    """Queries per category and per network, in one pass."""
    return queries.groupingSets([["category"], ["network_id"]], "category", "network_id").agg(F.count(F.lit(1)).alias("n"))


def diagnose(expected: DataFrame, people: DataFrame, near: DataFrame, ranks: DataFrame, bio_chars: int = 120) -> DataFrame:
    """Where each retrieval channel ranks every expected person.

    expected: goal_id, network_id, name. near: goal_id, person_id, rank, distance.
    ranks: goal_id, channel, person_id, rank, hits.
    """
    known = people.filter(~F.col("is_me")).groupBy("network_id", "name").agg(
        F.min(F.struct("person_id", F.coalesce("bio", F.lit("")).alias("bio"))).alias("w")
    ).select("network_id", "name", F.col("w.person_id").alias("person_id"), F.substring("w.bio", 1, bio_chars).alias("bio"))
    rows = expected.join(known, ["network_id", "name"], "left")
    vector = near.select("goal_id", "person_id", F.col("rank").alias("vector_rank"), "distance")
    out = rows.join(vector, ["goal_id", "person_id"], "left")
    for channel in ("helper", "topic"):
        part = ranks.filter(F.col("channel") == channel).select(
            "goal_id", "person_id", F.col("rank").alias(f"{channel}_rank"), F.col("hits").alias(f"{channel}_hits")
        )
        out = out.join(part, ["goal_id", "person_id"], "left")
    return out.withColumn("in_network", F.col("person_id").isNotNull())
