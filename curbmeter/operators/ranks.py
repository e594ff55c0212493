"""Numbers of rows in a sorted order, without one task that sees all rows (L1, M1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curbmeter.operators.buckets import local_table
from curbmeter.session import cut_lineage


def with_rank(df: DataFrame, *order, name: str = "rank", parts: int | None = None, weight: str | None = None) -> DataFrame:
    """Add the position of every row in ``order``, from 1, or the sum of ``weight`` up to and with it.

    Rows are dealt to ranges of the order and numbered within each; the sizes
    of the ranges before are added. Only these sizes, one number per range,
    come to the driver. ``order`` must tell all rows apart, else rows that tie
    get any of their numbers. Starts a job; a range is a task's share whatever
    the type of the keys.
    """
    size = F.sum(F.lit(1).cast("long") if weight is None else F.col(weight).cast("long"))
    spread = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    # A checkpoint, so that every later use sees the same ranges.
    dealt = cut_lineage(spread.withColumn("_range", F.spark_partition_id()))
    sizes = {r["_range"]: r["n"] for r in dealt.groupBy("_range").agg(size.alias("n")).collect()}
    before, offsets = 0, []
    for part in sorted(sizes):
        offsets.append((part, before))
        before += sizes[part]
    inside = size.over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    kinds = [T.StructField("_range", T.IntegerType()), T.StructField("_before", T.LongType())]
    shifts = local_table(df.sparkSession, offsets, T.StructType(kinds))
    # One row per range.
    return (
        dealt.withColumn("_inside", inside)
        .join(F.broadcast(shifts), "_range")
        .withColumn(name, F.col("_inside") + F.col("_before"))
        .drop("_range", "_inside", "_before")
    )
