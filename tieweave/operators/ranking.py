"""Ranking that stays distributed even when one group holds much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tieweave.session import cut


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of every group.

    Catalyst turns the rank filter into a window group limit below the exchange,
    so a task keeps at most ``k`` rows per group before anything is shuffled.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("long")).filter(F.col(rank) <= k)


def sums_before(df: DataFrame, group: list[str], order: list[Column], value: Column, out: str) -> DataFrame:
    """The sum of ``value`` over the rows before each row of a group in a total order, whatever the group size.

    A plain window sorts a whole group in one task. Here rows are range partitioned
    by (group, order), summed inside each slice, and shifted by the sums of the
    slices before; a group of any size is spread over many tasks. The checkpoint
    pins the slices, so both uses below see the same ones.
    """
    ranged = cut(
        df.repartitionByRange(*[F.col(c) for c in group], *order).withColumn("_slice", F.spark_partition_id())
    )
    sizes = ranged.groupBy(*group, "_slice").agg(F.sum(value).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(*group, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(shift, [*group, "_slice"])
        .withColumn(out, (F.col("_in") + F.col("_shift")).cast("long"))
        .drop("_in", "_shift", "_slice")
    )


def positions(df: DataFrame, group: list[str], order: list[Column], out: str) -> DataFrame:
    """Number the rows of every group 1..n in a total order, whatever the group size."""
    return sums_before(df, group, order, F.lit(1), out).withColumn(out, F.col(out) + 1)


def max_normalise(df: DataFrame, group: list[str], score: str) -> DataFrame:
    """Divide by the group's largest score; groups that peak at 0 are left alone."""
    peak = df.groupBy(*group).agg(F.max(score).alias("_peak"))
    safe = F.when(F.col("_peak") == 0, F.lit(1.0)).otherwise(F.col("_peak"))
    return df.join(peak, group).withColumn(score, F.col(score) / safe).drop("_peak")
