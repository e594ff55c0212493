"""All chart data sets of a cleaned table from two small aggregates.

Most analyses only need counts and sums per zone, hour, weekday and payment
type, or counts per pair of zones. Both tables are made once, in one scan each,
and checkpointed; every data set is then a grouping of a table whose size
depends on the keys and no longer on the trips. Distributions (A8, A10, A12)
need the values themselves and read the trips.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbmeter.functions.timing import with_clock
from curbmeter.functions.values import payment_label, percent, route_label
from curbmeter.operators import fares
from curbmeter.operators.demand import all_hours, count_on_grid, hour_columns, hour_grid
from curbmeter.operators.fares import CARD, CASH
from curbmeter.schema import DROPOFF_ZONE, FARE, PAYMENT, PICKUP_ZONE, TIP, TOLLS, TOTAL
from curbmeter.session import cut_lineage

MEASURES = (FARE, TIP, TOLLS, TOTAL)


def trip_cells(trips: DataFrame) -> DataFrame:
    """Trips, sums and numbers of values per zone, hour, weekday and payment type; missing keys are kept."""
    return (
        with_clock(trips)
        .groupBy(PICKUP_ZONE, "pickup_hour", "pickup_weekday", "is_weekend", PAYMENT)
        .agg(
            F.count("*").alias("trips"),
            *[F.sum(c).alias(f"sum_{c}") for c in MEASURES],
            *[F.count(c).alias(f"n_{c}") for c in MEASURES],
        )
    )


def zone_pairs(trips: DataFrame) -> DataFrame:
    """Trips per pair of zones; missing zones are kept."""
    return trips.groupBy(PICKUP_ZONE, DROPOFF_ZONE).agg(F.count("*").alias("trips"))


def _mean(column: str, where: Column | None = None) -> Column:
    """Mean of a measure over the cells of a group."""
    total, n = F.col(f"sum_{column}"), F.col(f"n_{column}")
    if where is not None:
        total, n = F.when(where, total), F.when(where, n)
    return F.try_divide(F.sum(total), F.sum(n))


def _ranked(counts: DataFrame, *keys: str, top: int) -> DataFrame:
    for key in keys:
        counts = counts.where(F.col(key).isNotNull())
    return counts.groupBy(*keys).agg(F.sum("trips").alias("trips")).orderBy(F.desc("trips"), *keys).limit(top)


def _demand_cube(cells: DataFrame) -> DataFrame:
    known = cells.where(F.col(PICKUP_ZONE).isNotNull() & F.col("pickup_hour").isNotNull())
    return known.groupBy(PICKUP_ZONE, "pickup_hour", "pickup_weekday").agg(F.sum("trips").alias("demand"))


def _weekday_hours(cells: DataFrame) -> DataFrame:
    grid = hour_grid(cells.sparkSession).select(F.explode(F.sequence(F.lit(0), F.lit(6))).alias("pickup_weekday"), "pickup_hour")
    return count_on_grid(cells, grid, F.col(f"n_{TOTAL}"))


def _top_zone_hours(cells: DataFrame, top: int = 5) -> DataFrame:
    # At most ``top`` rows.
    busiest = F.broadcast(_ranked(cells, PICKUP_ZONE, top=top).select(PICKUP_ZONE))
    empty = busiest.select(PICKUP_ZONE, all_hours().alias("pickup_hour"), F.lit(0).cast("long").alias("trips"))
    return (
        cells.where(F.col("pickup_hour").isNotNull())
        .join(busiest, PICKUP_ZONE)
        .select(*empty.columns)
        .unionByName(empty)
        .groupBy(PICKUP_ZONE, "pickup_hour")
        .agg(F.sum("trips").alias("trips"))
    )


def _hourly_fare(cells: DataFrame) -> DataFrame:
    columns = ["is_weekend", "pickup_hour", f"sum_{FARE}", f"n_{FARE}"]
    empty = hour_grid(cells.sparkSession, True).select(
        "*", F.lit(None).cast("double").alias(f"sum_{FARE}"), F.lit(0).cast("long").alias(f"n_{FARE}")
    )
    rows = cells.where(F.col("pickup_hour").isNotNull()).select(*columns).unionByName(empty)
    return rows.groupBy("is_weekend", "pickup_hour").agg(_mean(FARE).alias("avg_fare"), F.sum(f"n_{FARE}").alias("trips"))


def _payment_share(cells: DataFrame) -> DataFrame:
    counts = cells.groupBy(PAYMENT).agg(F.sum("trips").alias("trips"))
    total = cells.agg(F.sum("trips")).scalar()
    return counts.where(F.col(PAYMENT).isNotNull()).select(
        PAYMENT, payment_label(PAYMENT).alias("name"), "trips", percent(F.col("trips"), total, 1).alias("share_pct")
    )


def _fee_structure(cells: DataFrame) -> DataFrame:
    means = cells.where(F.col(PAYMENT).isin(CARD, CASH)).groupBy(PAYMENT).agg(
        *[F.bround(_mean(c), 2).alias(c) for c in MEASURES]
    )
    rest = F.col(TOTAL) - F.col(FARE) - F.col(TIP) - F.col(TOLLS)
    return means.withColumn("other_fees", F.bround(rest, 4))


def _hourly_payment_share(cells: DataFrame) -> DataFrame:
    paid = cells.where(F.col(PAYMENT).isin(CARD, CASH) & F.col("pickup_hour").isNotNull())
    empty = hour_grid(cells.sparkSession).select(
        "pickup_hour", F.lit(None).cast(cells.schema[PAYMENT].dataType).alias(PAYMENT), F.lit(0).cast("long").alias("trips")
    )
    counts = paid.select(*empty.columns).unionByName(empty).groupBy("pickup_hour").agg(
        F.sum("trips").alias("trips"),
        *[F.sum(F.when(F.col(PAYMENT) == t, F.col("trips")).otherwise(0)).alias(f"type_{t}") for t in (CARD, CASH)],
    )
    return counts.select(
        "pickup_hour",
        "trips",
        *[
            F.coalesce(percent(F.col(f"type_{t}"), F.col("trips"), 4), F.lit(0.0)).alias(f"type_{t}_pct")
            for t in (CARD, CASH)
        ],
    )


def _payment_means(cells: DataFrame) -> DataFrame:
    return cells.where(F.col(PAYMENT).isNotNull()).groupBy(PAYMENT).agg(
        *[F.bround(_mean(c), 2).alias(f"avg_{c}") for c in (FARE, TIP, TOTAL)]
    )


def _tip_means(cells: DataFrame) -> DataFrame:
    return cells.agg(
        F.bround(_mean(TIP, F.col(PAYMENT) == CARD), 2).alias("card_tip_avg"),
        F.bround(_mean(TIP, F.col(PAYMENT) == CASH), 2).alias("cash_tip_avg"),
    )


def run_analyses(trips: DataFrame, distributions: bool = True) -> dict[str, DataFrame]:
    """Every data set by name, with the rows of the single operators.

    The two aggregates are made at the call; the data sets are computed when
    they are used. ``distributions`` False leaves out the three that read the
    trips again.
    """
    cells, pairs = cut_lineage(trip_cells(trips)), cut_lineage(zone_pairs(trips))
    weekday_hours = _weekday_hours(cells)
    sets = {
        "demand_cube": _demand_cube(cells),
        "hourly_by_daytype": count_on_grid(cells, hour_grid(trips.sparkSession, True), F.col("trips")),
        "weekday_hour_counts": weekday_hours,
        "weekday_hour_matrix": hour_columns(weekday_hours),
        "top_pickup_zones": _ranked(cells, PICKUP_ZONE, top=10),
        "top_dropoff_zones": _ranked(pairs, DROPOFF_ZONE, top=10),
        "top5_zone_hourly": _top_zone_hours(cells),
        "od_flows": _ranked(pairs, PICKUP_ZONE, DROPOFF_ZONE, top=15).withColumn(
            "label", route_label(PICKUP_ZONE, DROPOFF_ZONE)
        ),
        "hourly_fare_by_daytype": _hourly_fare(cells),
        "payment_share": _payment_share(cells),
        "fee_structure": _fee_structure(cells),
        "hourly_payment_share": _hourly_payment_share(cells),
        "payment_means": _payment_means(cells),
        "tip_means": _tip_means(cells),
    }
    if distributions:
        sets |= {
            "distance_fare_clip": fares.distance_fare_points(trips),
            "fare_by_passengers": fares.fare_by_passengers(trips),
            "tip_rate": fares.tip_rates(trips),
        }
    return sets
