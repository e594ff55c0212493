"""Sample of a fixed size (L5) and histogram."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbmeter.operators.ranks import with_rank

# The sampling key is cut into this many ranges to find where the sample ends.
RANGES = 1 << 16


def default_key(df: DataFrame) -> Column:
    """A well-spread key of the whole row in [0, 1)."""
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return F.shiftrightunsigned(hashed, 11) / F.lit(float(1 << 53))


def fixed_sample(df: DataFrame, size: int, key: Column | None = None) -> DataFrame:
    """Exactly ``size`` rows (all when there are fewer), the same ones on every run.

    The rows with the smallest ``key`` in [0, 1) are taken, ties by all columns.
    A plain sort with limit would let every task send ``size`` rows to one
    task. Here a count per key range first tells in which range the sample
    ends, and only rows up to it are numbered, in ranges of their order and not in
    one task. Runs jobs at the call. Copies of a row have one key, so
    they are folded into a count before the shuffle and unfolded afterwards.
    """
    keyed = df.withColumn("_key", key if key is not None else default_key(df))
    slot = F.least(F.floor(F.col("_key") * RANGES), F.lit(RANGES - 1)).cast("int")
    keyed = keyed.withColumn("_slot", slot)
    counts = keyed.groupBy("_slot").agg(F.count("*").alias("n"))
    # At most RANGES rows are numbered here.
    past = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("_slot"))
    last = (
        counts.withColumn("first", past - F.col("n"))
        .where(F.col("first") < size)
        .agg(F.max("_slot"))
        .scalar()
    )
    columns = [F.col(f"`{c}`") for c in df.columns]
    folded = keyed.where(F.col("_slot") <= last).groupBy("_key", *columns).agg(F.count("*").alias("_n"))
    taken = F.col("_past") - F.col("_n")
    return (
        with_rank(folded, "_key", *columns, name="_past", weight="_n")
        .where(taken < size)
        .withColumn("_n", F.least(F.col("_n"), F.lit(size) - taken).cast("int"))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
        .select(*columns)
    )


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Equal-width histogram with density over the range of the values.

    The last bin includes the maximum. When all values are equal the range is
    widened by half a unit on both sides. Empty bins are listed with 0.
    """
    values = df.select(F.col(column).cast("double").alias("value")).where(
        F.col("value").isNotNull() & ~F.isnan("value")
    )
    ends = values.agg(F.min("value").alias("a"), F.max("value").alias("b")).where(
        F.col("a").isNotNull()
    )
    flat = F.col("a") == F.col("b")
    span = ends.select(
        F.struct(
            F.when(flat, F.col("a") - 0.5).otherwise(F.col("a")).alias("low"),
            F.when(flat, F.col("b") + 0.5).otherwise(F.col("b")).alias("high"),
        )
    ).scalar()
    bin_no = F.least(
        F.floor((F.col("value") - span["low"]) / (span["high"] - span["low"]) * bins),
        F.lit(bins - 1),
    ).cast("int")
    empty = df.sparkSession.range(0, bins, 1, 1).select(
        F.col("id").cast("int").alias("bin"), F.lit(0).cast("long").alias("n")
    )
    counts = (
        values.select(bin_no.alias("bin"), F.lit(1).cast("long").alias("n"))
        .unionByName(empty)
        .groupBy("bin")
        .agg(F.sum("n").alias("n"))
    )
    total = counts.agg(F.sum("n")).scalar()
    width = (span["high"] - span["low"]) / bins
    return counts.select(
        "bin",
        (span["low"] + width * F.col("bin")).alias("bin_start"),
        (span["low"] + width * (F.col("bin") + 1)).alias("bin_end"),
        "n",
        F.try_divide(F.col("n").cast("double"), total * width).alias("density"),
    )
