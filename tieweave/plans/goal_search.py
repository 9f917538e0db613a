"""Goal search end to end: retrieve, rerank, add paths, sort into buckets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from tieweave.functions.people import rationale
from tieweave.operators import paths as P, rerank as R
from tieweave.operators.analytics import me_rows, strength_to_me
from tieweave.operators.retrieval import hybrid_search
from tieweave.session import broadcast_if_small, cut

KEY = ["goal_id", "network_id"]


def ranked_results(candidates: DataFrame, forest: DataFrame, people: DataFrame) -> DataFrame:
    """Reachable candidates with name, rationale and the flags buckets need."""
    at = ["network_id", "person_id"]
    candidates = cut(candidates)
    # A few people of each goal (counted) travel to the paths and the people, of whom nobody else moves.
    asked = broadcast_if_small(candidates.select(*at).distinct())
    named = people.filter(~F.col("is_me")).select(*at, "name", "is_wishlist", "tags", "skills", "companies").join(asked, at, "left_semi")
    rows = P.rank_by_path(candidates, forest.join(asked, at, "left_semi")).join(named, at)
    return rows.withColumn(
        "rationale", rationale(F.col("kind"), F.col("score"), F.col("hops"), F.col("path_strength"))
    ).drop("tags", "skills", "companies")


def buckets(results: DataFrame, k: int = 5) -> DataFrame:
    """The four result lists of every goal, as rows with ``bucket`` and ``place``.

    The combined list draws on the shortened indirect list but on all direct contacts.
    """
    best = [F.col("combined").desc(), F.col("person_id")]
    # A goal has at most the retrieved candidates left, so one shuffle by goal serves
    # every window below.
    rows = results.repartition(*KEY).withColumn("_indirect", F.col("kind") == "indirect")
    at = lambda part, order: F.row_number().over(Window.partitionBy(*KEY, *part).orderBy(*order)).cast("long")
    rows = (
        rows.withColumn("_i", at(["_indirect"], best))
        .withColumn("_c", at(["_indirect"], [F.get("strengths", F.lit(0)).desc(), *best]))
        .withColumn("_w", at(["is_wishlist"], best))
        .withColumn("_pool", ~F.col("_indirect") | (F.col("_i") <= k))
        .withColumn("_a", at(["_pool"], best))
    )
    entry = lambda name, holds, place, n: F.when(
        holds & (F.col(place) <= n), F.struct(F.lit(name).alias("bucket"), F.col(place).alias("place"))
    )
    listed = F.array_compact(
        F.array(
            entry("indirect", F.col("_indirect"), "_i", k),
            entry("contacted", ~F.col("_indirect"), "_c", 2 * k),
            entry("wishlist", F.col("is_wishlist"), "_w", k),
            entry("combined", F.col("_pool"), "_a", k),
        )
    )
    out = rows.withColumn("_b", F.explode(listed))
    return out.select(*results.columns, F.col("_b.place").alias("place"), F.col("_b.bucket").alias("bucket"))


def goal_search(
    goals: DataFrame, people: DataFrame, edges: DataFrame, embeddings: DataFrame | None = None,
    reranker: Callable[[DataFrame], DataFrame] = R.identity, forest: DataFrame | None = None,
    top: int = 10, result_k: int = 5, recall_k: int = 30, max_hops: int = 3, weak_me_floor: int = 4,
    metric: str = "l2", weights: dict[str, float] | None = None, wildcards: bool = False,
) -> DataFrame:
    """All buckets of all goals. The forest depends on the edges only and may be reused.

    ``weights`` and ``wildcards`` are those of ``hybrid_search``.
    """
    me = me_rows(people)
    if forest is None:
        forest = P.path_forest(edges, me, max_hops, weak_me_floor)
    found = hybrid_search(goals, people, embeddings, top, recall_k, metric, weights=weights, wildcards=wildcards)
    results = ranked_results(R.cut_to(reranker(found), top), forest, people)
    listed = cut(buckets(results, result_k))
    shown = broadcast_if_small(listed.select("network_id", "person_id").distinct())
    known = strength_to_me(edges, me).join(shown, ["network_id", "person_id"], "left_semi").select("network_id", "person_id", F.col("strength_to_me").alias("direct_strength"))
    fallback = (F.col("kind") == "indirect") & F.col("bucket").isin("indirect", "combined")
    return listed.join(known, ["network_id", "person_id"], "left").withColumn(
        "direct_strength", F.when(fallback, F.col("direct_strength"))
    )
