"""Trips derived from a ``lineitem`` table.

Integer arithmetic on the keys turns every line into one trip with all the
kinds of dirt the cleaning rules know, and one line in about a hundred into
two identical trips. Each line is read once: the copy is made by ``explode``
and not by a second scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick(*branches, otherwise) -> Column:
    """First branch whose condition holds."""
    chain = F
    for condition, value in branches:
        chain = chain.when(condition, F.lit(value) if not isinstance(value, Column) else value)
    return chain.otherwise(otherwise)


def trips_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """One trip per line, two for every line with ``a % 101 = 0``."""
    h = (
        F.col("l_orderkey") * 7919
        + F.col("l_linenumber") * 104729
        + F.col("l_partkey") * 1299709
        + F.col("l_suppkey") * 15485863
    )
    base = lineitem.select("*", h.alias("h")).select(
        "*",
        (F.col("h") % 1009).alias("a"),
        (F.col("h") % 10007 % 100).alias("b"),
        (F.col("h") % 100003 % 86400).alias("s"),
        (F.col("l_extendedprice") / 1000.0).alias("fare0"),
    )
    a, b, fare0 = F.col("a"), F.col("b"), F.col("fare0")
    pickup = F.col("l_shipdate") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), F.col("s").cast("decimal(18,6)")
    )
    ride = F.make_dt_interval(F.lit(0), F.lit(0), (b % 61 - 1).cast("int"))
    tip = F.when(b < 60, fare0 * F.col("l_discount") * 3.0).otherwise(0.0)
    tolls = F.when(a % 17 == 0, 6.55).otherwise(0.0)
    null = F.lit(None)
    copies = F.when(a % 101 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))

    return base.select(
        _pick(
            (a % 79 == 0, null), (a % 97 == 0, 6), (a % 89 == 0, 7), otherwise=b % 2 + 1
        ).cast("int").alias("VendorID"),
        pickup.alias("tpep_pickup_datetime"),
        (pickup + ride).alias("tpep_dropoff_datetime"),
        _pick((a % 41 == 0, null), (b < 3, 0), otherwise=b % 6 + 1)
        .cast("double").alias("passenger_count"),
        _pick((b == 7, 0.0), (b == 8, -1.0), otherwise=F.col("l_quantity") / 2.0)
        .alias("trip_distance"),
        _pick((a % 43 == 0, null), (b.between(90, 92), 99), otherwise=a % 6 + 1)
        .cast("double").alias("RatecodeID"),
        _pick(
            (a % 37 == 0, null), (b == 11, " Y"), (b == 12, "N "), (b == 13, "X"), (b < 20, "Y"),
            otherwise="N",
        ).alias("store_and_fwd_flag"),
        (F.col("l_suppkey") % 265 + 1).cast("int").alias("PULocationID"),
        (F.col("l_partkey") % 265 + 1).cast("int").alias("DOLocationID"),
        _pick(
            (a % 83 == 0, null), (b < 60, 1), (b < 85, 2), (b < 88, 3), (b < 91, 4), (b < 93, 0),
            (b < 95, 5), (b < 97, 6), otherwise=1,
        ).cast("int").alias("payment_type"),
        F.when(b == 9, -fare0).otherwise(fare0).alias("fare_amount"),
        tip.alias("tip_amount"),
        tolls.alias("tolls_amount"),
        F.when(b == 10, 0.0)
        .otherwise(fare0 * (F.lit(1.0) + F.col("l_tax")) + 3.5 + tip + tolls)
        .alias("total_amount"),
        F.when(a % 3 == 0, F.col("l_tax")).alias("airport_fee"),
        F.explode(copies).alias("copy"),
    ).drop("copy")
