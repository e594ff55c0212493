"""The parameterised questions (Q1, Q2, Q4-Q6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbmeter.functions.timing import minutes_between, with_clock
from curbmeter.functions.values import mean, payment_label, percent
from curbmeter.operators.demand import (
    count_on_grid,
    first_peak,
    group_counts,
    hour_grid,
    with_key,
)
from curbmeter.operators.fares import CARD, CASH
from curbmeter.schema import (
    BOARDING,
    DISTANCE,
    DROPOFF_TIME,
    DROPOFF_ZONE,
    FARE,
    PAYMENT,
    PICKUP_TIME,
    PICKUP_ZONE,
    TIP,
    TOTAL,
    WEEKEND,
    WORKDAY,
)


def in_zone(df: DataFrame, column: str, zone_id: int | None) -> DataFrame:
    """Rows of one zone, or all when none is asked for; 0 is a zone like any other."""
    return df if zone_id is None else df.where(F.col(column) == int(zone_id))


def hourly_demand(
    trips: DataFrame,
    location: int | None = None,
    day_type: str | None = None,
    zone: str = PICKUP_ZONE,
    pickup_time: str = PICKUP_TIME,
) -> DataFrame:
    """Trips in each of the 24 hours for a zone and day type, both optional (Q1)."""
    rows = with_clock(in_zone(trips, zone, location), pickup_time)
    if day_type == WORKDAY:
        rows = rows.where(~F.col("is_weekend"))
    elif day_type == WEEKEND:
        rows = rows.where("is_weekend")
    return count_on_grid(rows, hour_grid(trips.sparkSession))


def hourly_demand_answer(trips: DataFrame, *args, **kwargs) -> DataFrame:
    """Peak, mean, morning peak (6-9) and evening peak (16-19) of the 24 hours."""
    hour, n = F.col("pickup_hour"), F.col("trips")

    def within(first: int, last: int) -> tuple:
        inside = hour.between(first, last)
        return (
            first_peak(F.when(inside, hour), F.when(inside, n)),
            F.max(F.when(inside, n)),
        )

    morning, evening = within(6, 9), within(16, 19)
    return hourly_demand(trips, *args, **kwargs).agg(
        first_peak(hour, n).alias("peak_hour"),
        F.max(n).alias("peak_trips"),
        mean(n, 1).alias("avg_demand"),
        morning[0].alias("morning_peak_hour"),
        morning[1].alias("morning_peak_trips"),
        evening[0].alias("evening_peak_hour"),
        evening[1].alias("evening_peak_trips"),
    )


def location_ranking(
    trips: DataFrame,
    rank_type: str = BOARDING,
    top_n: int = 10,
    pickup_zone: str = PICKUP_ZONE,
    dropoff_zone: str = DROPOFF_ZONE,
) -> DataFrame:
    """The busiest zones by boarding or alighting and how many zones there are (Q2)."""
    column = pickup_zone if rank_type == BOARDING else dropoff_zone
    counts = group_counts(trips, column)
    # Counting through the trips keeps the plan of ``counts`` the same for both uses.
    zones = counts.agg(F.count_if(F.col("trips") > 0)).scalar()
    return (
        counts.orderBy(F.desc("trips"), column)
        .limit(top_n)
        .select(F.col(column).alias("location"), "trips", zones.alias("total_locations"))
    )


def _route_means(pickup_time: str, dropoff_time: str) -> dict:
    """Name, averaged column and printed digits of the means of a route."""
    minutes = minutes_between(pickup_time, dropoff_time)
    return {
        "avg_distance": (F.col(DISTANCE), 2),
        "avg_fare": (F.col(FARE), 2),
        "avg_total": (F.col(TOTAL), 2),
        "avg_duration_min": (minutes, 1),
        "avg_tip": (F.col(TIP), 2),
    }


def route_description(origin: int | None, destination: int | None) -> str:
    """The filters of a route question in words."""
    parts = []
    if origin is not None:
        parts.append(f"出发区域{origin}")
    if destination is not None:
        parts.append(f"到达区域{destination}")
    return "、".join(parts) or "全路线"


def route_info(
    trips: DataFrame,
    location_from: int | None = None,
    location_to: int | None = None,
    pickup_zone: str = PICKUP_ZONE,
    dropoff_zone: str = DROPOFF_ZONE,
    pickup_time: str = PICKUP_TIME,
    dropoff_time: str = DROPOFF_TIME,
) -> DataFrame:
    """Count and means of the trips between two zones, each optional (Q4).

    Without a matching trip the count is 0 and the means are null.
    """
    rows = in_zone(in_zone(trips, pickup_zone, location_from), dropoff_zone, location_to)
    means = [mean(value, digits).alias(name) for name, (value, digits) in _route_means(pickup_time, dropoff_time).items()]
    return rows.agg(F.count("*").alias("trip_count"), *means).withColumn(
        "description", F.lit(route_description(location_from, location_to))
    )


def route_table(
    trips: DataFrame,
    pickup_zone: str = PICKUP_ZONE,
    dropoff_zone: str = DROPOFF_ZONE,
    pickup_time: str = PICKUP_TIME,
    dropoff_time: str = DROPOFF_TIME,
) -> DataFrame:
    """The same for every pair of zones at once, means in full (Q4)."""
    known = F.col(pickup_zone).isNotNull() & F.col(dropoff_zone).isNotNull()
    return (
        trips.where(known)
        .groupBy(pickup_zone, dropoff_zone)
        .agg(
            F.count("*").alias("trip_count"),
            *[F.avg(value).alias(name) for name, (value, _) in _route_means(pickup_time, dropoff_time).items()],
        )
    )


def payment_analysis(trips: DataFrame, payment: str = PAYMENT, tip: str = TIP) -> DataFrame:
    """Share and means per payment type, with the mean card and cash tip on every row (Q5)."""
    groups = trips.groupBy(payment).agg(
        F.count("*").alias("trips"), *[mean(c).alias(f"avg_{c}") for c in (FARE, tip, TOTAL)]
    )
    whole = (
        groups.agg(
            F.sum("trips").alias("trips"),
            *[
                F.max(F.when(F.col(payment) == code, F.col(f"avg_{tip}"))).alias(name)
                for code, name in ((CARD, "card_tip_avg"), (CASH, "cash_tip_avg"))
            ],
        )
        .select(F.struct("trips", "card_tip_avg", "cash_tip_avg"))
        .scalar()
    )
    return with_key(groups, payment).select(
        payment,
        payment_label(payment).alias("name"),
        "trips",
        percent(F.col("trips"), whole["trips"], 1).alias("share_pct"),
        *[f"avg_{c}" for c in (FARE, tip, TOTAL)],
        whole["card_tip_avg"].alias("card_tip_avg"),
        whole["cash_tip_avg"].alias("cash_tip_avg"),
    )


def peak_hours(
    trips: DataFrame,
    location: int | None = None,
    zone: str = PICKUP_ZONE,
    pickup_time: str = PICKUP_TIME,
) -> DataFrame:
    """Trips per hour on workdays and on weekends for a zone or all of them (Q6)."""
    rows = with_clock(in_zone(trips, zone, location), pickup_time)
    return count_on_grid(rows, hour_grid(trips.sparkSession, True))
