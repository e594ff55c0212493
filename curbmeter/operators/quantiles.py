"""Exact quantiles by selection.

The built-in ``percentile`` gathers every distinct value of a group in one
task. Here a quantile is found the way one looks up a word in a dictionary:

1. count rows in coarse buckets (about 0.8 % of the value wide) and see from
   the running total which bucket holds the wanted rank; a bucket of one value
   is an answer already,
2. read only the rows of the other buckets again and count them per value,
3. within the bucket, first find the right slot of an even grid and then the
   value in that slot.

Buckets are a fixed monotone function of the value and all counts are exact
integers, so the result is exact and the same on every run. The shuffles carry
counts, pre-aggregated on the map side, so neither a hot group nor a hot value
gathers rows in one task, and no task sorts more than one slot.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curbmeter.operators.buckets import Distribution, bucket_of, local_table, tall_values, without_null_keys
from curbmeter.session import broadcast_if_small, cut_lineage

SLOTS = 4096  # slots of the grid within one bucket
def _running(counts: DataFrame, group: list, order: str) -> DataFrame:
    """Add the ranks ``[first, past)`` that a row's ``n`` values take in its group."""
    past = F.sum("n").over(Window.partitionBy(*group).orderBy(order))
    return counts.withColumn("past", past).withColumn("first", F.col("past") - F.col("n"))


def _holds(rank: Column) -> Column:
    return (F.col("first") <= rank) & (rank < F.col("past"))


def exact_quantiles(df: DataFrame, columns, probabilities, by=(), few_groups: bool = False) -> DataFrame:
    """Quantiles with linear interpolation, nulls and NaN left out.

    Returns ``(*by, column, p, value)``; a group and column without values has
    no row, nor have rows with a null in ``by``. Without ``by``, or if
    ``few_groups`` states that it has a small fixed domain, they are found at
    the call from a :class:`~curbmeter.operators.buckets.Distribution`, else
    as below: the wanted buckets, at most two per probability, column and group,
    are checkpointed, and broadcast only if they are few: a shuffle join would
    move every value.
    """
    if few_groups or not by:
        return _few_quantiles(df, list(columns), probabilities, list(by))
    df = without_null_keys(df, by)
    keys = [*by, "column"]
    values = tall_values(df, columns, by)
    buckets = values.withColumn("bucket", bucket_of(F.col("value"))).groupBy(*keys, "bucket").agg(
        F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    place = [*keys, "bucket", "lo", "hi"]
    hits = cut_lineage(_wanted_buckets(buckets, keys, probabilities))
    known = hits.where("lo = hi")
    hits = hits.where("lo < hi")

    near = values.withColumn("bucket", bucket_of(F.col("value"))).join(
        broadcast_if_small(hits.select(*place).distinct()), [*keys, "bucket"]
    )
    near = near.withColumn(
        "slot",
        F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * SLOTS).cast("int"),
    )
    cell = [*place, "slot"]
    distinct = near.groupBy(*cell, "value").agg(F.count("*").alias("n"))
    slots = _running(distinct.groupBy(*cell).agg(F.sum("n").alias("n")), place, "slot")
    hits = cut_lineage(
        slots.join(broadcast_if_small(hits), place)
        .where(_holds(F.col("rank")))
        .select(*cell, "p", "part", (F.col("rank") - F.col("first")).alias("rank"))
    )
    distinct = distinct.join(broadcast_if_small(hits.select(*cell).distinct()), cell, "left_semi")
    found = _running(distinct, cell, "value").join(broadcast_if_small(hits), cell).where(_holds(F.col("rank")))
    columns = [*keys, "p", "part", "value"]
    found = found.select(*columns).unionAll(known.withColumn("value", F.col("lo")).select(*columns))
    low, high = F.min("value"), F.max("value")
    return found.groupBy(*keys, "p").agg(
        F.when(low == high, low)
        .otherwise(low + (high - low) * F.max("part"))
        .alias("value")
    )


def _few_quantiles(df: DataFrame, columns: list, probabilities, by: list) -> DataFrame:
    """The same from the state of few groups; a row per group, column and probability comes from the driver."""
    known = Distribution(df, columns, by)
    asked = [([key], float(p), None) for key in known.parts for p in probabilities]
    for keys, p, _ in asked:
        known.want_quantile(keys, p)
    known.read()
    rows = [(*keys[0], p, value) for (keys, p, _), value in zip(asked, known.quantiles(asked))]
    fields = [*[df.schema[k] for k in by], *[T.StructField("column", T.StringType()), T.StructField("p", T.DoubleType()), T.StructField("value", T.DoubleType())]]
    return local_table(df.sparkSession, rows, T.StructType(fields))


def _wanted_buckets(buckets: DataFrame, keys: list, probabilities) -> DataFrame:
    """``(*keys, bucket, lo, hi, p, part, rank)``: the buckets that hold a wanted rank, with the rank in them."""
    total = F.sum("n").over(Window.partitionBy(*keys))
    ranked = _running(buckets.withColumn("total", total), keys, "bucket")
    position = [F.lit(float(p)) * (F.col("total") - 1) for p in probabilities]
    wanted = F.array(
        *[
            F.struct(
                F.lit(float(p)).alias("p"),
                side(at).cast("long").alias("rank"),
                (at - F.floor(at)).alias("part"),
            )
            for p, at in zip(probabilities, position)
            for side in (F.floor, F.ceil)
        ]
    )
    place = [*keys, "bucket", "lo", "hi"]
    return ranked.select(
        *place,
        "first",
        F.explode(F.array_distinct(F.filter(wanted, lambda w: _holds(w["rank"])))).alias("w"),
    ).select(*place, "w.p", "w.part", (F.col("w.rank") - F.col("first")).alias("rank"))


def quantiles(
    df: DataFrame, columns, probabilities, by=(), few_groups: bool = False, exact: bool = True
) -> DataFrame:
    """:func:`exact_quantiles`, or one cheap pass of ``percentile_approx``."""
    if exact:
        return exact_quantiles(df, columns, probabilities, by, few_groups)
    wide = without_null_keys(df, by).groupBy(*by).agg(
        *[
            F.percentile_approx(
                F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")),
                list(map(float, probabilities)),
            ).alias(f"_q{i}")
            for i, c in enumerate(columns)
        ]
    )
    parts = [
        wide.select(
            *by,
            F.lit(c).alias("column"),
            F.explode(
                F.arrays_zip(
                    F.array(*[F.lit(float(p)) for p in probabilities]).alias("p"),
                    F.col(f"_q{i}").alias("value"),
                )
            ).alias("q"),
        ).select(*by, "column", "q.p", "q.value")
        for i, c in enumerate(columns)
    ]
    return reduce(DataFrame.unionAll, parts).where(F.col("value").isNotNull())


def quartile_columns(found: DataFrame, names: dict, by=()) -> DataFrame:
    """Turn ``(column, p, value)`` rows into one column per probability of ``names``."""
    return found.groupBy(*by, "column").agg(
        *[F.max(F.when(F.col("p") == p, F.col("value"))).alias(name) for p, name in names.items()]
    )


def quantile_limits(df: DataFrame, columns, p: float, exact: bool = True) -> dict:
    """One quantile per column as numbers for a filter on every row.

    Runs its jobs at once and returns one number per named column, None for a
    column without values. As literals the limits are part of the pushed-down
    filter, and the plan that uses them does not repeat the search for them.
    """
    found = {row["column"]: row["value"] for row in quantiles(df, columns, [p], exact=exact).collect()}
    return {c: found.get(c) for c in columns}
