"""Demand by zone, hour and weekday (A1-A7, A19) and the hour grids.

Hourly results have a row for every hour. The empty hours are appended to the
input as rows that count nothing, so one aggregation gives the full grid and no
join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curbmeter.functions.timing import with_clock
from curbmeter.functions.values import route_label
from curbmeter.schema import DROPOFF_ZONE, FARE, PICKUP_TIME, PICKUP_ZONE, TOTAL


def all_hours() -> Column:
    """One row per hour of the day, when exploded."""
    return F.explode(F.sequence(F.lit(0), F.lit(23)))


def hour_grid(spark: SparkSession, by_day_type: bool = False) -> DataFrame:
    """The 24 hours, or the 48 pairs of day type and hour."""
    hours = spark.range(0, 24, 1, 1).select(F.col("id").cast("int").alias("pickup_hour"))
    if not by_day_type:
        return hours
    return hours.select(
        F.explode(F.array(F.lit(False), F.lit(True))).alias("is_weekend"), "pickup_hour"
    )


def count_on_grid(df: DataFrame, grid: DataFrame, weight: Column | None = None) -> DataFrame:
    """Rows per cell of ``grid``, 0 for cells without rows.

    ``weight`` is what a row counts for, 1 by default.
    """
    keys = grid.columns
    weight = F.lit(1) if weight is None else weight
    rows = df.where(F.col(keys[-1]).isNotNull()).select(*keys, weight.cast("long").alias("trips"))
    empty = grid.select(*keys, F.lit(0).cast("long").alias("trips"))
    return rows.unionByName(empty).groupBy(*keys).agg(F.sum("trips").alias("trips"))


def demand_cube(df: DataFrame, zone: str = PICKUP_ZONE, pickup_time: str = PICKUP_TIME) -> DataFrame:
    """Trips per zone, hour and weekday; cells without trips are absent (A1)."""
    return (
        with_clock(df.where(F.col(zone).isNotNull() & F.col(pickup_time).isNotNull()), pickup_time)
        .groupBy(zone, "pickup_hour", "pickup_weekday")
        .agg(F.count("*").alias("demand"))
    )


def demand_summary(cube: DataFrame, zone: str = PICKUP_ZONE) -> DataFrame:
    """Cells, zones and the range and mean of demand (A2)."""
    by_zone = cube.groupBy(zone).agg(
        F.count("*").alias("cells"),
        F.min("demand").alias("lo"),
        F.max("demand").alias("hi"),
        F.sum("demand").alias("trips"),
    )
    return by_zone.agg(
        F.coalesce(F.sum("cells"), F.lit(0)).alias("cells"),
        F.count("*").alias("zones"),
        F.min("lo").alias("min_demand"),
        F.max("hi").alias("max_demand"),
        F.bround(F.try_divide(F.sum("trips").cast("double"), F.sum("cells")), 2).alias("mean_demand"),
    )


def hourly_by_day_type(df: DataFrame, pickup_time: str = PICKUP_TIME) -> DataFrame:
    """Trips per hour on workdays and on weekends (A3)."""
    return count_on_grid(with_clock(df, pickup_time), hour_grid(df.sparkSession, True))


def weekday_hour_counts(
    df: DataFrame, counted: str = TOTAL, pickup_time: str = PICKUP_TIME
) -> DataFrame:
    """Rows with a value in ``counted`` per weekday and hour, all 168 cells (A4)."""
    grid = hour_grid(df.sparkSession).select(
        F.explode(F.sequence(F.lit(0), F.lit(6))).alias("pickup_weekday"), "pickup_hour"
    )
    return count_on_grid(with_clock(df, pickup_time), grid, F.col(counted).isNotNull().cast("int"))


def weekday_hour_matrix(
    df: DataFrame, counted: str = TOTAL, pickup_time: str = PICKUP_TIME
) -> DataFrame:
    """The same as a matrix: one row per weekday, one column per hour."""
    return hour_columns(weekday_hour_counts(df, counted, pickup_time))


def hour_columns(cells: DataFrame) -> DataFrame:
    """Counts per weekday and hour with the hours as columns."""
    return cells.groupBy("pickup_weekday").agg(
        *[
            F.sum(F.when(F.col("pickup_hour") == h, F.col("trips"))).alias(f"h{h:02d}")
            for h in range(24)
        ]
    )


def group_counts(df: DataFrame, *keys: str, name: str = "trips") -> DataFrame:
    """Rows per key, rows with a missing key left out."""
    for key in keys:
        df = df.where(F.col(key).isNotNull())
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def with_key(counts: DataFrame, key: str, name: str = "trips") -> DataFrame:
    """Leave out the group of the missing key after the count.

    The test looks at the count as well, so it is not pushed below the
    aggregation and every use of ``counts`` stays the same plan, run once.
    """
    return counts.where(F.when(F.col(key).isNotNull(), F.col(name)) > 0)


def distinct_values(df: DataFrame, column: str, first: int | None = None) -> DataFrame:
    """The distinct values in order, all or the first few."""
    values = group_counts(df, column).select(column)
    return values.orderBy(column).limit(first) if first else values


def distinct_count(df: DataFrame, column: str, exact: bool = True) -> DataFrame:
    """Number of distinct values (A17), exact or by one pass of ``approx_count_distinct``.

    The exact form counts groups and not a set per task, so it spreads over
    all tasks however many values there are.
    """
    if not exact:
        return df.agg(F.approx_count_distinct(column).alias("distinct_values"))
    return group_counts(df, column).agg(F.count("*").alias("distinct_values"))


def top_groups(df: DataFrame, *keys: str, top: int = 10) -> DataFrame:
    """The keys with the most rows; ties go to the smaller key (A5, L1, L4)."""
    return group_counts(df, *keys).orderBy(F.desc("trips"), *keys).limit(top)


def top_zone_hours(
    df: DataFrame, zone: str = PICKUP_ZONE, top: int = 5, pickup_time: str = PICKUP_TIME
) -> DataFrame:
    """Trips per hour in each of the busiest zones.

    Counts per zone and hour hold all that is needed: the ranking adds them up
    and the profile picks from them, so the trips are read once.
    """
    cells = group_counts(with_clock(df, pickup_time), zone, "pickup_hour")
    totals = cells.groupBy(zone).agg(F.sum("trips").alias("zone_trips"))
    # At most ``top`` rows.
    busiest = F.broadcast(totals.orderBy(F.desc("zone_trips"), zone).limit(top).select(zone))
    empty = busiest.select(
        zone, all_hours().alias("pickup_hour"), F.lit(0).cast("long").alias("trips")
    )
    return (
        # Not a semi join: that would be pushed below the count and read the trips again.
        cells.join(busiest, zone)
        .unionByName(empty)
        .groupBy(zone, "pickup_hour")
        .agg(F.sum("trips").alias("trips"))
    )


def flows(
    df: DataFrame, origin: str = PICKUP_ZONE, destination: str = DROPOFF_ZONE, top: int = 15
) -> DataFrame:
    """The busiest pairs of origin and destination with their label."""
    return top_groups(df, origin, destination, top=top).withColumn(
        "label", route_label(origin, destination)
    )


def hourly_fare_by_day_type(
    df: DataFrame, fare: str = FARE, pickup_time: str = PICKUP_TIME
) -> DataFrame:
    """Mean fare per hour on workdays and weekends and the fares it is of; null for an hour without any."""
    grid = hour_grid(df.sparkSession, True)
    rows = with_clock(df, pickup_time).select("is_weekend", "pickup_hour", fare)
    empty = grid.withColumn(fare, F.lit(None).cast("double"))
    return (
        rows.where(F.col("pickup_hour").isNotNull())
        .unionByName(empty)
        .groupBy("is_weekend", "pickup_hour")
        .agg(F.avg(fare).alias("avg_fare"), F.count(fare).alias("trips"))
    )


def first_peak(hour: Column, trips: Column) -> Column:
    """The hour with the most trips, the earliest one of several."""
    return F.max_by(hour, F.struct(trips, -hour))
