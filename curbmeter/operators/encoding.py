"""Zone codes, scaling and the train/test split (M1-M4)."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbmeter.functions.timing import cycle_cos, cycle_sin, is_rush, is_weekend_day
from curbmeter.operators.demand import group_counts
from curbmeter.operators.ranks import with_rank
from curbmeter.schema import PICKUP_ZONE

# The model features in their order.
FEATURES = (
    "location_encoded",
    "hour_sin",
    "hour_cos",
    "weekday_sin",
    "weekday_cos",
    "is_weekend",
    "is_rush_hour",
)


def zone_encoder(df: DataFrame, zone: str = PICKUP_ZONE) -> DataFrame:
    """Codes 0..k-1 for the zones in numeric order (M1).

    The zones are numbered in ranges of their ids, so no task sees more than
    its share of them, however wide the ids are. Runs a job at the call.
    """
    zones = group_counts(df, zone).select(zone)
    return with_rank(zones, zone, name="_rank").select(zone, (F.col("_rank") - 1).cast("int").alias("location_encoded"))


def encode_zones(df: DataFrame, encoder: DataFrame, zone: str = PICKUP_ZONE) -> DataFrame:
    """Add the zone code; an unknown zone gets code 0 and ``known_zone`` false."""
    codes = encoder.withColumnRenamed("location_encoded", "_code")
    return (
        df.join(codes, zone, "left")
        .withColumn("location_encoded", F.coalesce("_code", F.lit(0)))
        .withColumn("known_zone", F.col("_code").isNotNull())
        .drop("_code")
    )


def with_demand_features(
    df: DataFrame, hour: str = "pickup_hour", weekday: str = "pickup_weekday"
) -> DataFrame:
    """Add the cyclic and flag features of an hour and a weekday column."""
    h, d = F.col(hour), F.col(weekday)
    return df.withColumns(
        {
            "hour_sin": cycle_sin(h, 24),
            "hour_cos": cycle_cos(h, 24),
            "weekday_sin": cycle_sin(d, 7),
            "weekday_cos": cycle_cos(d, 7),
            "is_weekend": is_weekend_day(d).cast("int"),
            "is_rush_hour": is_rush(h).cast("int"),
        }
    )


def demand_features(cube: DataFrame, encoder: DataFrame, zone: str = PICKUP_ZONE) -> DataFrame:
    """The demand cube with all model features."""
    return with_demand_features(encode_zones(cube, encoder, zone)).drop("known_zone")


def with_vector(df: DataFrame, features=FEATURES) -> DataFrame:
    """Add the feature vector (M2)."""
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df)


def scaling(fit_on: DataFrame, columns) -> Column:
    """Mean and population deviation of each column as one scalar struct (M3).

    A constant column gets deviation 1, so that scaling only centres it.
    """
    one = fit_on.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"std_{c}") for c in columns],
    )
    parts = [F.col(f"mean_{c}") for c in columns] + [
        F.when(F.col(f"std_{c}") == 0, 1.0).otherwise(F.col(f"std_{c}")).alias(f"std_{c}")
        for c in columns
    ]
    return one.select(F.struct(*parts)).scalar()


def standardise(df: DataFrame, columns, fit_on: DataFrame | None = None) -> DataFrame:
    """Replace the columns by their z-scores (M3); fitted on ``fit_on`` or on ``df`` itself."""
    columns = list(columns)
    fitted = scaling(fit_on if fit_on is not None else df, columns)
    return df.withColumns(
        {c: (F.col(c) - fitted[f"mean_{c}"]) / fitted[f"std_{c}"] for c in columns}
    )


def unscale(df: DataFrame, columns: dict, fit_on: DataFrame) -> DataFrame:
    """Undo the scaling; ``columns`` maps a scaled column to the column it was fitted on (M3)."""
    fitted = scaling(fit_on, list(columns.values()))
    return df.withColumns(
        {c: F.col(c) * fitted[f"std_{o}"] + fitted[f"mean_{o}"] for c, o in columns.items()}
    )


def is_test_cell(zone: str = PICKUP_ZONE) -> Column:
    """One cell in five, chosen by its keys and so the same in every run (M4)."""
    return (
        F.pmod(
            F.col(zone) * 131 + F.col("pickup_hour") * 17 + F.col("pickup_weekday") * 7, F.lit(5)
        )
        == 0
    )


def split(df: DataFrame, zone: str = PICKUP_ZONE) -> tuple:
    """Train and test part of the demand cells, 80 to 20 (M4)."""
    test = is_test_cell(zone)
    return df.where(~test), df.where(test)


def random_split(df: DataFrame, test: float = 0.2, seed: int = 42) -> tuple:
    """A seeded random split instead of the keyed one (M4)."""
    parts = df.randomSplit([1.0 - test, test], seed)
    return parts[0], parts[1]


def split_counts(df: DataFrame, zone: str = PICKUP_ZONE) -> DataFrame:
    """Sizes of the two parts (M4)."""
    return df.agg(
        F.count_if(~is_test_cell(zone)).alias("train"), F.count_if(is_test_cell(zone)).alias("test")
    )
