"""Goal retrieval: nearest vectors, keyword hits and their weighted rank fusion."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tieweave.functions import values as V
from tieweave.functions.people import search_haystack
from tieweave.operators.ranking import positions, top_k
from tieweave.operators.substring import contained_terms
from tieweave.session import fits

# Goals whose vectors may travel to every task; more goals take the co-grouped way.
GOALS_IN_TASK = 5_000
# People ids are cut into ranges of this width, so a group stays small in any network.
SLICE = 65_536
GOALS_PER_BLOCK = 1_024

_HIT = "goal_id long, network_id string, person_id long, distance double"


def _distances(vectors: np.ndarray, query: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        norms = np.linalg.norm(vectors, axis=1) * np.linalg.norm(query)
        return 1.0 - (vectors @ query) / np.where(norms == 0, 1.0, norms)
    diff = vectors - query
    return np.sqrt((diff * diff).sum(axis=1))


def _nearest(people: pd.DataFrame, goals: pd.DataFrame, k: int, metric: str) -> pd.DataFrame:
    """The k nearest people of each goal within one block of both."""
    if people.empty or goals.empty:
        return pd.DataFrame(columns=["goal_id", "network_id", "person_id", "distance"])
    ids = people["person_id"].to_numpy()
    vectors = np.stack(people["vector"].to_numpy()).astype(np.float64)
    out = []
    for goal_id, network_id, query in zip(goals["goal_id"], goals["network_id"], goals["vector"]):
        d = _distances(vectors, np.asarray(query, dtype=np.float64), metric)
        # Keep everything as close as the k-th, then order by (distance, id).
        edge = np.partition(d, k - 1)[k - 1] if len(d) > k else np.inf
        keep = np.flatnonzero(d <= edge)
        keep = keep[np.lexsort((ids[keep], d[keep]))][:k]
        out.append(pd.DataFrame({"goal_id": goal_id, "network_id": network_id, "person_id": ids[keep], "distance": d[keep]}))
    return pd.concat(out, ignore_index=True)


def nearest_people(
    goals: DataFrame, embeddings: DataFrame, k: int, metric: str = "l2",
    me: DataFrame | None = None, goals_in_task: int = GOALS_IN_TASK,
) -> DataFrame:
    """Exact k nearest people of every goal within the goal's network.

    With a counted, small number of goals the vectors are scanned where they lie and
    each task returns at most k rows per goal. With more goals, people (cut by id
    range) and goals (cut into blocks) meet in bounded groups. Both are exact.
    """
    asked = goals.select("goal_id", "network_id", "vector").filter(F.col("vector").isNotNull())
    known = embeddings.select("network_id", "person_id", "vector")
    if me is not None:
        known = known.join(me.select("network_id", F.col("me_id").alias("person_id")), ["network_id", "person_id"], "left_anti")
    if fits(asked, goals_in_task):
        partial = _scan(asked, known, k, metric)
    else:
        partial = _blocks(asked, known, k, metric)
    order = [F.col("distance"), F.col("person_id")]
    return top_k(partial, ["goal_id", "network_id"], order, k)


def _scan(asked: DataFrame, known: DataFrame, k: int, metric: str) -> DataFrame:
    by_network = {n: g for n, g in asked.toPandas().groupby("network_id")}  # counted above
    shared = asked.sparkSession.sparkContext.broadcast(by_network)

    def scan(batches):
        best: dict = {}
        for batch in batches:
            for network, people in batch.groupby("network_id"):
                if network not in shared.value:
                    continue
                hits = _nearest(people, shared.value[network], k, metric)
                if network in best:
                    hits = pd.concat([best[network], hits], ignore_index=True)
                hits = hits.sort_values(["goal_id", "distance", "person_id"])
                best[network] = hits.groupby("goal_id").head(k)
        yield from best.values()

    return known.mapInPandas(scan, _HIT)


def _blocks(asked: DataFrame, known: DataFrame, k: int, metric: str) -> DataFrame:
    counts = asked.groupBy("network_id").agg(F.ceil(F.count(F.lit(1)) / GOALS_PER_BLOCK).alias("_blocks"))
    goals = asked.join(counts, "network_id").withColumn("_block", F.pmod(F.xxhash64("goal_id"), F.col("_blocks")))
    people = known.withColumn("_slice", F.floor(F.col("person_id") / SLICE))
    goals_at = goals.join(people.select("network_id", "_slice").distinct(), "network_id")
    people_at = people.join(goals.select("network_id", "_block").distinct(), "network_id")
    # Both sides descend from the same frames; fresh names keep their columns apart.
    goals_at = goals_at.select(*[F.col(c).alias(c) for c in goals_at.columns])
    people_at = people_at.select(*[F.col(c).alias(c) for c in people_at.columns])
    key = ["network_id", "_slice", "_block"]

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _nearest(right, left, k, metric)

    return goals_at.groupBy(*key).cogroup(people_at.groupBy(*key)).applyInPandas(meet, _HIT)


def goal_terms(goals: DataFrame) -> DataFrame:
    """Folded words of every goal by channel; a repeated word counts as often as given."""
    helper = F.concat("roles", "industries", "skills")
    topic = F.concat("keywords", "cities")
    each = F.array(
        F.struct(F.lit("helper").alias("channel"), helper.alias("words")),
        F.struct(F.lit("topic").alias("channel"), topic.alias("words")),
    )
    return (
        goals.select("goal_id", "network_id", F.explode(each).alias("c"))
        .select("goal_id", "network_id", "c.channel", F.explode("c.words").alias("term"))
        .withColumn("term", F.lower(F.trim("term")))
        .filter(F.col("term") != "")
        .groupBy("goal_id", "network_id", "channel", "term")
        .agg(F.count(F.lit(1)).alias("times"))
    )


def keyword_hits(goals: DataFrame, people: DataFrame, wildcards: bool = False) -> DataFrame:
    """(goal, channel, person, hits): how many of the goal's words the person's fields hold.

    With ``wildcards``, ``%`` and ``_`` in a word stand for any characters and for one.
    """
    terms = goal_terms(goals)
    texts = people.filter(~F.col("is_me")).select("network_id", "person_id", search_haystack().alias("text"))
    found = contained_terms(texts, terms, ["network_id"], ["person_id"], wildcards=wildcards)
    return (
        found.join(terms, ["network_id", "term"])
        .groupBy("goal_id", "network_id", "channel", "person_id")
        .agg(F.sum("times").alias("hits"))
    )


def keyword_ranks(goals: DataFrame, people: DataFrame, wildcards: bool = False) -> DataFrame:
    """Every hit ranked by number of words found."""
    order = [F.col("hits").desc(), F.col("person_id")]
    return positions(keyword_hits(goals, people, wildcards), ["goal_id", "network_id", "channel"], order, "rank")


def fuse(channels: DataFrame, recall: int, rrf_k: int = V.RRF_K, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted reciprocal-rank fusion, scaled so that each goal's best score is 1.

    ``channels``: goal_id, network_id, person_id, channel, rank. The channels are added
    in a fixed order so that equal sums are equal to the last bit.
    """
    weights = weights or V.CHANNEL_WEIGHTS
    key = ["goal_id", "network_id"]
    parts = [
        F.coalesce(F.max(F.when(F.col("channel") == name, F.lit(w) / (rrf_k + F.col("rank")))), F.lit(0.0))
        for name, w in weights.items()
    ]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    fused = channels.groupBy(*key, "person_id").agg(total.alias("score"))
    best = top_k(fused, key, [F.col("score").desc(), F.col("person_id")], recall)
    peak = F.max("score").over(Window.partitionBy(*key))  # at most ``recall`` rows per goal by now
    return best.withColumn("score", F.col("score") / peak)


def hybrid_search(
    goals: DataFrame, people: DataFrame, embeddings: DataFrame | None,
    top: int = 10, recall_k: int | None = 30, metric: str = "l2", rrf_k: int = V.RRF_K,
    weights: dict[str, float] | None = None, wildcards: bool = False,
) -> DataFrame:
    """Candidates of every goal: goal_id, network_id, person_id, score, rank.

    ``weights`` gives a weight to some of the channels vector, helper and topic; the others
    keep theirs. Whom only channels of weight 0 found is no candidate.
    """
    weights = {**V.CHANNEL_WEIGHTS, **(weights or {})}
    unknown = set(weights) - set(V.CHANNEL_WEIGHTS)
    if unknown or min(weights.values()) < 0:
        raise ValueError(f"weights are numbers from 0 for {', '.join(V.CHANNEL_WEIGHTS)}")
    recall = max(top, recall_k or top)
    channels = keyword_ranks(goals, people, wildcards).select("goal_id", "network_id", "person_id", "channel", "rank")
    if embeddings is not None and weights["vector"] > 0:
        me = people.filter("is_me").select("network_id", F.col("person_id").alias("me_id"))
        told = goals.filter(F.trim(F.concat_ws("", "summary", "original")) != "")
        near = nearest_people(told, embeddings, recall * 2, metric, me)
        channels = channels.unionByName(
            near.select("goal_id", "network_id", "person_id", F.lit("vector").alias("channel"), "rank")
        )
    used = [name for name, w in weights.items() if w > 0]
    return fuse(channels.filter(F.col("channel").isin(used)), recall, rrf_k, weights)
