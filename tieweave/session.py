"""Session helpers: durable storage for lineage cuts and checked broadcasts."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# A side is only broadcast after its rows were counted against this limit.
BROADCAST_ROWS = 20_000


def durable_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written tables.

    The cluster names it in ``spark.checkpoint.dir``; a temporary folder is
    chosen only for a local master that names none.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    current = sc.getCheckpointDir()
    if current is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        current = sc.getCheckpointDir()
    return current


def work_path(spark: SparkSession, *parts: str) -> str:
    """A path below the durable folder that belongs to this application."""
    tail = "/".join(parts)
    return f"{durable_dir(spark)}/tieweave-{spark.sparkContext.applicationId}/{tail}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor."""
    durable_dir(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """Like ``cut``, as a written table: smaller on disk, and read by column. The shuffles behind it are let go at once.

    Shuffle files stay until the driver's heap is collected, which may be long after the last use.
    """
    spark = df.sparkSession
    path = work_path(spark, "kept", uuid.uuid4().hex)
    df.write.option("compression", "zstd").parquet(path)
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables of one operator: they cut lineage like a checkpoint and are removed when the operator ends."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path, self.n, self.held = spark, work_path(spark, "scratch", uuid.uuid4().hex), 0, []

    def __enter__(self) -> Scratch:
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.path}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{self.n}")

    def hold(self, df: DataFrame) -> DataFrame:
        """Persisted with its partitioning, for a table that every round reads; lost parts are computed anew."""
        self.held.append(df.persist())
        return self.held[-1]

    def __exit__(self, *_) -> None:
        for df in self.held:
            df.unpersist()
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def write_once(spark: SparkSession, key: str, name: str, build) -> DataFrame:
    """Write ``build()`` below the durable folder once per application and read it back."""
    digest = hashlib.sha1(key.encode()).hexdigest()[:12]
    path = work_path(spark, "tables", digest, name)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; never reads more than ``rows + 1``."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only when the counted size is within the limit, else a plain join side."""
    return F.broadcast(df) if fits(df, rows) else df
