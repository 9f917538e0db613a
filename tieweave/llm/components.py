"""Connected components of links, for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tieweave.session import cut

#: So many edges are few: their least neighbours are sent to the tasks, and their rounds run in FEW_TASKS tasks a step.
FEW_EDGES, FEW_TASKS = 100_000, 8


def _stars(edges: DataFrame, both: bool, few: bool) -> DataFrame:
    """One star step on edges (u, v): neighbours of u point to the least of them.

    ``both``: edges count both ways and only larger neighbours are moved; otherwise v < u
    and all of u's neighbours, and u itself, are moved.
    """
    around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    if few:
        least = least.coalesce(FEW_TASKS)
    met = around.join(F.broadcast(least) if few else least, F.col("u") == F.col("_u")).drop("_u")
    if both:
        return met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    moved = met.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("_u").alias("u"), F.col("m").alias("v")))


def components(links: DataFrame, a: str = "a", b: str = "b", few_edges: int = FEW_EDGES) -> DataFrame:
    """node, component (its least node) of every linked node.

    Large and small stars in turn, until nothing moves; a path of n nodes takes about log n
    rounds. Minima combine before each shuffle and each round is a reliable checkpoint.
    Repeated links, both directions and self-links are fine; no links give no rows. Tables of up
    to ``few_edges`` edges, counted in every round, are not dealt out over all shuffle partitions.
    """
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        mark = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if mark == seen or not mark["n"]:
            break
        seen, few = mark, mark["n"] <= few_edges
        if few:
            edges = edges.coalesce(FEW_TASKS)
        moved = _stars(_stars(edges, True, few), False, few).distinct()
        edges = cut(moved.coalesce(FEW_TASKS) if few else moved)
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
