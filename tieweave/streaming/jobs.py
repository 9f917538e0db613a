"""Structured Streaming versions of the folds: edges, people and scrubbed text.

Each micro-batch is folded on its own and written to a folder named after its batch id,
so its cost follows the batch and not the whole state; replaying a batch rewrites the
same folder from the same input. Every few batches the parts are folded into a full
snapshot. The folds are associative and keep ``seq``, so parts may be combined in any
grouping and a late row never displaces a newer one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tieweave.functions.text import scrub
from tieweave.operators.folding import upsert_edges


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _finished(spark: SparkSession, path: str) -> list[int]:
    """Batch ids of the completely written folders below ``path``."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    out = []
    for status in fs.listStatus(p):
        name = status.getPath().getName()
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS")
        if name.startswith("batch=") and fs.exists(done):
            out.append(int(name.split("=")[1]))
    return sorted(out)


def state(spark: SparkSession, path: str, fold: Callable[[DataFrame], DataFrame], upto: int | None = None) -> DataFrame:
    """Folded state after batch ``upto`` (or the latest): newest snapshot and the parts after it."""
    within = lambda v: upto is None or v <= upto
    full = [v for v in _finished(spark, f"{path}/full") if within(v)]
    base = full[-1] if full else -1
    parts = [f"{path}/part/batch={v}" for v in _finished(spark, f"{path}/part") if within(v) and v > base]
    if base >= 0:
        parts.insert(0, f"{path}/full/batch={base}")
    return fold(spark.read.parquet(*parts))


def folding_stream(
    stream: DataFrame, path: str, checkpoint: str, fold: Callable[[DataFrame], DataFrame], once: bool = True, compact_every: int = 20,
) -> StreamingQuery:
    """Fold a stream of writes into parts and snapshots below ``path``."""

    def step(batch: DataFrame, batch_id: int) -> None:
        fold(batch).write.mode("overwrite").parquet(f"{path}/part/batch={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            state(batch.sparkSession, path, fold, batch_id).write.mode("overwrite").parquet(f"{path}/full/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def fold_edges(writes: DataFrame) -> DataFrame:
    return upsert_edges(writes, keep_seq=True).select(*writes.columns)


def edge_stream(stream: DataFrame, path: str, checkpoint: str, once: bool = True, compact_every: int = 20) -> StreamingQuery:
    """Edge writes (with ``seq``) folded by provenance; read with ``state(.., fold_edges)``."""
    return folding_stream(stream, path, checkpoint, fold_edges, once, compact_every)


def person_stream(stream: DataFrame, path: str, checkpoint: str, once: bool = True, compact_every: int = 20) -> StreamingQuery:
    """Person patches kept as the shortest equivalent log; read with ``state(.., compact_patches)``
    and turned into a snapshot by ``tieweave.operators.changes.apply_person_patches``."""
    return folding_stream(stream, path, checkpoint, compact_patches, once, compact_every)


def compact_patches(log: DataFrame) -> DataFrame:
    """Drop log rows that can no longer matter: per person and field the last value, and
    the last delete. The result is again a log with the same meaning."""
    key = ["network_id", "person_id"]
    fields = [c for c in log.columns if c not in (*key, "seq", "op")]
    gone = log.filter("op = 'delete'").groupBy(*key).agg(F.max("seq").alias("seq"))
    types = {f.name: f.dataType for f in log.schema.fields}
    live = log.filter("op <> 'delete'").join(gone.select(*key, F.col("seq").alias("_gone")), key, "left")
    live = live.filter(F.col("_gone").isNull() | (F.col("seq") > F.col("_gone")))
    last = live.groupBy(*key).agg(*[F.max(F.when(F.col(c).isNotNull(), F.struct("seq", F.col(c).alias("v")))).alias(c) for c in fields])
    parts = [
        F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.seq").alias("seq"), *[
            (F.col(f"{c}.v") if d == c else F.lit(None).cast(types[d])).alias(d) for d in fields
        ])) for c in fields
    ]
    rows = last.select(*key, F.explode(F.array_compact(F.array(*parts))).alias("r")).select(*key, F.lit("put").alias("op"), "r.*")
    empty = [F.lit(None).cast(types[c]).alias(c) for c in fields]
    return rows.unionByName(gone.select(*key, F.lit("delete").alias("op"), "seq", *empty)).select(*log.columns)


def scrub_stream(stream: DataFrame, columns: list[str]) -> DataFrame:
    """Mask personal data in text columns; stateless, for streams and batches alike."""
    return stream.withColumns({c: scrub(F.col(c)) for c in columns})


def write_scrubbed(stream: DataFrame, columns: list[str], path: str, checkpoint: str) -> StreamingQuery:
    return (
        scrub_stream(stream, columns).writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
