"""Time features (F1-F9) as column expressions.

All of them stay inside whole-stage codegen and read wall-clock fields, so a
``TIMESTAMP_NTZ`` column gives the same answer in every session time zone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbmeter.schema import DROPOFF_TIME, PICKUP_TIME, RUSH_HOURS, WEEKEND_DAYS


def weekday(ts) -> Column:
    """Day of the week, Monday = 0 (F2)."""
    return F.weekday(ts)


def is_weekend_day(day: Column) -> Column:
    """True for Saturday and Sunday of a Monday = 0 weekday."""
    return day.isin(*WEEKEND_DAYS)


def is_rush(hour: Column) -> Column:
    """True in the morning and evening rush hours."""
    return hour.isin(*RUSH_HOURS)


def cycle_sin(value: Column, period: int) -> Column:
    """Sine of the position in a cycle, so that both its ends are neighbours."""
    return F.sin(value * F.lit(2 * math.pi) / F.lit(float(period)))


def cycle_cos(value: Column, period: int) -> Column:
    """Cosine of the position in a cycle."""
    return F.cos(value * F.lit(2 * math.pi) / F.lit(float(period)))


def minutes_between(start, end) -> Column:
    """Minutes from ``start`` to ``end`` with the fraction kept."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(6e7)


def with_clock(df: DataFrame, pickup_time: str = PICKUP_TIME) -> DataFrame:
    """Hour, weekday and weekend flag only: what the aggregates need."""
    return df.withColumns(
        {
            "pickup_hour": F.hour(pickup_time),
            "pickup_weekday": weekday(pickup_time),
            "is_weekend": is_weekend_day(weekday(pickup_time)),
        }
    )


def with_time_features(df: DataFrame, pickup_time: str = PICKUP_TIME) -> DataFrame:
    """Add the full set of pickup features."""
    moment = F.col(pickup_time).cast("timestamp_ntz")
    hour, day = F.hour(moment), weekday(moment)
    return df.withColumns(
        {
            "pickup_datetime": moment,
            "pickup_date": F.to_date(moment),
            "pickup_hour": hour,
            "pickup_weekday": day,
            "pickup_day": F.dayofmonth(moment),
            "is_weekend": is_weekend_day(day),
            "is_rush_hour": is_rush(hour),
            "hour_sin": cycle_sin(hour, 24),
            "hour_cos": cycle_cos(hour, 24),
            "weekday_sin": cycle_sin(day, 7),
            "weekday_cos": cycle_cos(day, 7),
        }
    )


def with_duration(
    df: DataFrame, pickup_time: str = PICKUP_TIME, dropoff_time: str = DROPOFF_TIME
) -> DataFrame:
    """Add the trip duration in minutes."""
    return df.withColumn("duration_min", minutes_between(pickup_time, dropoff_time))
