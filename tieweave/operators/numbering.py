"""Ids of edges that are written again."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tieweave.operators.ranking import positions
from tieweave.session import cut

NET = "network_id"


def mark_known(edges: DataFrame, known: DataFrame | None) -> DataFrame:
    """Edges with ``edge_id`` (null where new), ``introduced_by_id`` and every column of ``known`` that the writes do not have."""
    none = F.lit(None).cast("long")
    if known is None:
        return cut(edges.drop("edge_id").withColumn("edge_id", none).withColumn("introduced_by_id", none))
    key = [NET, "source_id", "target_id"]
    written = edges.drop("edge_id", "introduced_by_id")
    more = [c for c in known.columns if c not in written.columns and c != "edge_id"]
    kept = known.groupBy(*key).agg(F.max(F.struct("edge_id", *more)).alias("_kept"))
    marked = cut(written.join(kept, key, "left").select(*written.columns, "_kept.edge_id", *[F.col(f"_kept.{c}").alias(c) for c in more]))
    return marked if "introduced_by_id" in more else marked.withColumn("introduced_by_id", none)


def with_edge_ids(edges: DataFrame, known: DataFrame | None) -> DataFrame:
    """Edges with ``edge_id`` and ``introduced_by_id``: those of known edges stay, new ones are numbered on from the largest.

    A known direction that is written again keeps its id, whoever wrote last, and every column of
    ``known`` that the writes do not have. Only new edges are sorted.
    """
    order = [F.col("source_id"), F.col("target_id")]
    if known is None:
        fresh = positions(edges.drop("edge_id"), [NET], order, "edge_id")
        return fresh.withColumn("introduced_by_id", F.lit(None).cast("long"))
    marked = mark_known(edges, known)
    fresh = positions(marked.filter(F.col("edge_id").isNull()).drop("edge_id"), [NET], order, "_n")
    top = known.groupBy(NET).agg(F.max("edge_id").alias("_top"))
    numbered = fresh.join(top, NET, "left").withColumn("edge_id", F.col("_n") + F.greatest(F.coalesce("_top", F.lit(0)), F.lit(0))).drop("_n", "_top")
    return marked.filter(F.col("edge_id").isNotNull()).unionByName(numbered)
