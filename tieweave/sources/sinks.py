"""Writers: graph export and evaluation reports."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Nodes and edges, one folder per network each."""
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.repartition("network_id", "person_id" if name == "nodes" else "source_id").write.mode("overwrite").partitionBy(
            "network_id"
        ).format(fmt).save(f"{path}/{name}")


def write_report(summary: DataFrame, detail: DataFrame, path: str) -> None:
    """Evaluation summary and per-query detail as JSON."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    detail.write.mode("overwrite").json(f"{path}/detail")
