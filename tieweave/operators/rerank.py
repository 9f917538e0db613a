"""Second-stage reordering of each goal's candidate head.

Candidates: goal_id, network_id, person_id, score, rank. ``rank`` is the order; scores
of the tail are left as they were, so only ``rank`` tells the order afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tieweave.functions import values as V

HEAD = 30


def identity(candidates: DataFrame) -> DataFrame:
    return candidates


def parse_verdicts(responses: DataFrame) -> DataFrame:
    """(goal_id, token, role, score) from judge answers ``{"ranking": [{id, role, score}]}``.

    Entries of the wrong type are skipped, unknown roles become the default role, a
    score that is no number is 0, and the last entry of a token wins. Responses:
    goal_id, raw.
    """
    parsed = responses.select("goal_id", F.try_parse_json("raw").alias("v"))
    entries = parsed.select(
        "goal_id", F.posexplode(F.expr("try_variant_get(v, '$.ranking', 'array<variant>')")).alias("at", "e")
    ).filter(F.expr("schema_of_variant(e) like 'OBJECT%' and schema_of_variant(try_variant_get(e, '$.id', 'variant')) = 'STRING'"))
    role = F.trim(F.expr("try_variant_get(e, '$.role', 'string')"))
    score = F.coalesce(F.expr("try_variant_get(e, '$.score', 'double')"), F.lit(0.0))
    rows = entries.select(
        "goal_id", "at",
        F.trim(F.expr("try_variant_get(e, '$.id', 'string')")).alias("token"),
        F.when(role.isin(*V.ROLE_WEIGHTS), role).otherwise(F.lit(V.DEFAULT_ROLE)).alias("role"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.isnan(score), 0.0).otherwise(score))).alias("score"),
    )
    return (
        rows.groupBy("goal_id", "token").agg(F.max(F.struct("at", "role", "score")).alias("w"))
        .select("goal_id", "token", F.col("w.role").alias("role"), F.col("w.score").alias("verdict"))
    )


def head_tokens(candidates: DataFrame, head: int = HEAD) -> DataFrame:
    """Head candidates with the placeholder the judge sees, numbered in rank order."""
    return candidates.filter(F.col("rank") <= head).withColumn("token", F.format_string("P%03d", F.col("rank").cast("int")))


def _merge(candidates: DataFrame, head: DataFrame, max_head: int) -> DataFrame:
    """Scored heads, then tails; goals without any scored head keep their order.

    ``head``: goal_id, network_id, person_id, old, new. Everything is at most one
    candidate list per goal, so the windows are small.
    """
    key = ["goal_id", "network_id"]
    w = Window.partitionBy(*key)
    peak = F.max("new").over(w)
    placed = head.select(
        *key, "person_id",
        (F.col("new") / F.when(peak == 0, F.lit(1.0)).otherwise(peak)).alias("new_score"),
        F.row_number().over(w.orderBy(F.col("new").desc(), F.col("old").desc(), F.col("person_id"))).alias("new_rank"),
    )
    done = placed.select(*key).distinct().withColumn("done", F.lit(True))
    rows = candidates.join(placed, [*key, "person_id"], "left").join(done, key, "left")
    in_head = F.col("rank") <= max_head
    kept = rows.filter(F.col("done").isNull() | ~in_head | F.col("new_rank").isNotNull())
    order = [F.when(in_head, 0).otherwise(1), F.coalesce("new_rank", "rank")]
    return kept.select(
        *key, "person_id", F.coalesce("new_score", "score").alias("score"),
        F.row_number().over(w.orderBy(*order)).cast("long").alias("rank"),
    )


def judge(candidates: DataFrame, responses: DataFrame, head: int = HEAD) -> DataFrame:
    """Blend judge roles and scores into the head: role weight x verdict score.

    Head candidates without a verdict get 0.05 of their score. Goals whose answer has
    no usable entry keep their order.
    """
    heads = head_tokens(candidates, max(1, head))
    verdicts = parse_verdicts(responses).join(heads.select("goal_id", "token"), ["goal_id", "token"], "left_semi")
    weight = F.lit(V.ROLE_WEIGHTS[V.DEFAULT_ROLE])
    for role, w in V.ROLE_WEIGHTS.items():
        weight = F.when(F.col("role") == role, F.lit(w)).otherwise(weight)
    judged = verdicts.select("goal_id").distinct()
    blended = (
        heads.join(judged, "goal_id", "left_semi")
        .join(verdicts, ["goal_id", "token"], "left")
        .withColumn(
            "new",
            F.when(F.col("role").isNull(), F.col("score") * V.ROLE_WEIGHTS[V.DEFAULT_ROLE])
            .otherwise(weight * F.col("verdict")),
        )
        .select("goal_id", "network_id", "person_id", F.col("score").alias("old"), "new")
    )
    return _merge(candidates, blended, max(1, head))


def pair_scores(candidates: DataFrame, scores: DataFrame, head: int = HEAD) -> DataFrame:
    """Order the head by supplied pair scores (goal_id, person_id, pair_score).

    Head candidates that could not be scored drop out of a scored goal.
    """
    scored = (
        candidates.filter(F.col("rank") <= max(1, head))
        .join(scores, ["goal_id", "person_id"])
        .select("goal_id", "network_id", "person_id", F.col("score").alias("old"), F.col("pair_score").alias("new"))
    )
    return _merge(candidates, scored, max(1, head))


def cut_to(candidates: DataFrame, k: int) -> DataFrame:
    return candidates.filter(F.col("rank") <= k)
