"""Introduction paths: scoring and describing best paths, and all short paths between two people."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, functions as F

from tieweave.operators.folding import both_ways, undirected
from tieweave.operators.forest import clamp_floor, path_forest, path_kind, weighted_graph  # noqa: F401
from tieweave.operators.ranking import top_k
from tieweave.operators.substring import contained_terms
from tieweave.session import cut

def combined_score(relevance, path_strength, hops):
    """Relevance, nudged by mean strength (at most 10 %), discounted by hops."""
    mean = path_strength / hops
    return relevance * (0.9 + 0.1 * (mean / 5.0)) * (1.0 / F.pow(hops.cast("double"), F.lit(1.3)))


def rank_by_path(candidates: DataFrame, forest: DataFrame) -> DataFrame:
    """Candidates that can be reached, with their path and combined score."""
    joined = candidates.join(forest, ["network_id", "person_id"])
    return joined.withColumn("combined", combined_score(F.col("score"), F.col("path_strength"), F.col("hops")))


def path_legs(paths: DataFrame, keys: list[str]) -> DataFrame:
    """One row per leg of each path: keys, at, from_id, to_id, low_id, high_id."""
    at = F.sequence(F.lit(1), F.size("path") - 1)
    legs = paths.filter(F.size("path") > 1).select(*keys, F.explode(
        F.transform(at, lambda i: F.struct(i.alias("at"), F.get("path", i - 1).alias("from_id"), F.get("path", i).alias("to_id")))
    ).alias("l"))
    return legs.select(
        *keys, "l.at", "l.from_id", "l.to_id",
        F.least("l.from_id", "l.to_id").alias("low_id"), F.greatest("l.from_id", "l.to_id").alias("high_id"),
    )


def describe_paths(paths: DataFrame, people: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Names and edge contexts along each path, as two arrays next to the keys.

    A path has at most max_hops + 1 people, so the gathered lists are short.
    """
    names = people.select("network_id", F.col("person_id").alias("to_id"), "name")
    start = paths.select(*keys, F.lit(0).alias("at"), F.get("path", F.lit(0)).alias("to_id"), F.lit(None).cast("string").alias("context"))
    legs = path_legs(paths, keys).join(pairs.select("network_id", "low_id", "high_id", "context"), ["network_id", "low_id", "high_id"])
    steps = start.unionByName(legs.select(*keys, "at", "to_id", "context")).join(names, ["network_id", "to_id"])
    listed = steps.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("at", "name", "context"))).alias("s"))
    return listed.select(
        *keys, F.transform("s", lambda x: x["name"]).alias("names"), F.transform("s", lambda x: x["context"]).alias("contexts")
    )


def highlights(results: DataFrame) -> DataFrame:
    """Distinct people and edges on the result paths of every goal."""
    keys = ["goal_id", "network_id"]
    results = cut(results.select(*keys, "path"))  # read twice below
    nodes = results.select(*keys, F.lit("node").alias("kind"), F.explode(F.col("path").cast("array<string>")).alias("element"))
    legs = path_legs(results, keys)
    edge = F.concat_ws("_", F.lit("e"), F.col("low_id").cast("string"), F.col("high_id").cast("string"))
    return nodes.unionByName(legs.select(*keys, F.lit("edge").alias("kind"), edge.alias("element"))).distinct()


def direct_instead(results: DataFrame) -> DataFrame:
    """The one-hop alternative of an indirect result whose person the owner knows directly."""
    me = F.get("path", F.lit(0))
    return results.filter((F.col("kind") == "indirect") & F.col("direct_strength").isNotNull()).select(
        "goal_id", "network_id", "person_id",
        F.array(me, F.col("person_id")).alias("path"),
        F.array(F.col("direct_strength")).alias("strengths"),
        F.concat(F.lit("直连：你与 "), F.col("name"), F.lit(" 关系强度 "), F.col("direct_strength").cast("string"),
                 F.lit("/5，可直接联系。")).alias("rationale"),
    )


def paths_between(requests: DataFrame, edges: DataFrame, max_hops: int = 3, max_paths: int = 5) -> DataFrame:
    """Best simple paths between two people, by mean strength.

    Requests: request_id, network_id, source_id, target_id. Paths grow from both ends until two legs
    are missing between them. The person in between is looked for among the neighbours of the end
    with fewer of them, and the leg to the other end is looked up: a path that comes by somebody with
    very many contacts costs what the other end's contacts cost.
    """
    pairs = undirected(edges).select("network_id", "low_id", "high_id", "strength")
    hop = both_ways(pairs).select("network_id", F.col("from_id").alias("node"), "to_id", F.col("strength").alias("s"))
    degree = hop.groupBy("network_id", "node").agg(F.count(F.lit(1)).alias("degree"))
    key = ["request_id", "network_id"]
    asked = requests.filter("source_id <> target_id")
    for x in ("source", "target"):
        asked = asked.join(degree.select("network_id", F.col("node").alias(f"{x}_id"), F.col("degree").alias(f"_{x}")), ["network_id", f"{x}_id"])
    turned = F.col("_source") > F.col("_target")
    asked = asked.select(
        *key, F.when(turned, F.col("target_id")).otherwise(F.col("source_id")).alias("source_id"),
        F.when(turned, F.col("source_id")).otherwise(F.col("target_id")).alias("target_id"), turned.alias("turned"),
    )

    def grown(start: str, other: str, legs: int) -> DataFrame:
        rows = asked.select(*key, "turned", F.col(other).alias("avoid"), F.col(start).alias("node"), F.array(start).alias("path"), F.lit(0).alias("total"))
        for _ in range(legs):
            free = (F.col("to_id") != F.col("avoid")) & ~F.array_contains(F.col("path"), F.col("to_id"))
            rows = rows.join(hop, ["network_id", "node"]).filter(free).select(
                *key, "turned", "avoid", F.col("to_id").alias("node"), F.array_append("path", F.col("to_id")).alias("path"), (F.col("total") + F.col("s")).alias("total"),
            )
        return rows.drop("avoid")

    def closed(hops: int) -> DataFrame:
        """Paths of ``hops`` legs: both ends grown to meet over one person in between."""
        ahead, back = (hops - 1) // 2, (hops - 2) // 2
        named = lambda rows, x: rows.select(*key, "turned", F.col("node").alias(f"end_{x}"), F.col("path").alias(f"path_{x}"), F.col("total").alias(f"total_{x}"))
        both = named(grown("source_id", "target_id", ahead), "a").join(named(grown("target_id", "source_id", back), "b"), [*key, "turned"])
        both = both.filter(~F.arrays_overlap("path_a", "path_b"))
        for x in "ab":
            both = both.join(degree.select("network_id", F.col("node").alias(f"end_{x}"), F.col("degree").alias(f"degree_{x}")), ["network_id", f"end_{x}"])
        a_is_less = F.col("degree_a") <= F.col("degree_b")
        both = both.withColumns({"node": F.when(a_is_less, F.col("end_a")).otherwise(F.col("end_b")), "far": F.when(a_is_less, F.col("end_b")).otherwise(F.col("end_a"))})
        met = both.join(hop, ["network_id", "node"]).filter(~F.array_contains("path_a", F.col("to_id")) & ~F.array_contains("path_b", F.col("to_id")))
        last = met.withColumns({"low_id": F.least("to_id", "far"), "high_id": F.greatest("to_id", "far")}).join(pairs, ["network_id", "low_id", "high_id"])
        path = F.concat("path_a", F.array("to_id"), F.reverse("path_b"))
        return last.select(*key, "turned", path.alias("path"), (F.col("total_a") + F.col("total_b") + F.col("s") + F.col("strength")).alias("total"), F.lit(hops).alias("hops"))

    straight = asked.withColumns({"low_id": F.least("source_id", "target_id"), "high_id": F.greatest("source_id", "target_id")})
    found = [straight.join(pairs, ["network_id", "low_id", "high_id"]).select(*key, "turned", F.array("source_id", "target_id").alias("path"), F.col("strength").alias("total"), F.lit(1).alias("hops"))]
    found += [closed(h) for h in range(2, max_hops + 1)]
    every = functools.reduce(DataFrame.unionByName, found).withColumn("combined", F.col("total") / F.col("hops"))
    every = every.withColumn("path", F.when(F.col("turned"), F.reverse("path")).otherwise(F.col("path"))).drop("turned")
    return top_k(every, key, [F.col("combined").desc(), F.col("hops"), F.col("path")], max_paths)


def resolve_names(requests: DataFrame, people: DataFrame) -> DataFrame:
    """Person meant by a typed name: same name in any case, else first name containing it.

    Requests: request_id, network_id, typed. Rows add person_id, name, exact and same_name.
    """
    key = ["network_id", "term"]
    asked = requests.select("request_id", "network_id", "typed", F.lower(F.trim("typed")).alias("term")).filter(F.col("term") != "").distinct()
    best = F.min(F.struct(~F.col("is_me"), "name", "person_id")).alias("w")
    # A term is looked up once, however many requests typed it, and only one that is nobody's whole name is
    # searched for inside names. Names compress so well that files of them look small enough to broadcast.
    same = people.groupBy("network_id", F.lower("name").alias("term")).agg(best, F.count(F.lit(1)).alias("same_name"))
    terms = asked.select(*key).distinct()
    whole = terms.join(same.hint("merge"), key).withColumn("exact", F.lit(True))
    others = terms.join(same.select(*key).hint("merge"), key, "left_anti")
    hits = contained_terms(people.select("network_id", "person_id", F.lower("name").alias("text")), others, ["network_id"], ["person_id"])
    inside = hits.join(people.select("network_id", "person_id", "name", "is_me").hint("merge"), ["network_id", "person_id"]).groupBy(*key).agg(best)
    met = whole.unionByName(inside.select(*key, "w", F.lit(0).cast("long").alias("same_name"), F.lit(False).alias("exact")))
    return asked.join(met.hint("merge"), key).select(
        "request_id", "network_id", "typed", F.col("w.person_id").alias("person_id"), F.col("w.name").alias("name"), "exact", "same_name"
    )


def resolve_endpoints(requests: DataFrame, people: DataFrame) -> DataFrame:
    """Both ends of typed path requests; requests without two different people drop out.

    Requests: request_id, network_id, start_typed, end_typed.
    """
    def end(col: str, out: str) -> DataFrame:
        named = resolve_names(requests.select("request_id", "network_id", F.col(col).alias("typed")), people)
        return named.select("request_id", "network_id", F.col("person_id").alias(out),
                            (F.col("same_name") > 1).alias(f"{out}_ambiguous"))

    both = end("start_typed", "source_id").join(end("end_typed", "target_id").hint("merge"), ["request_id", "network_id"])
    return both.filter("source_id <> target_id")
