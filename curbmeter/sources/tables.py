"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curbmeter.schema import PICKUP_TIME, PICKUP_ZONE, TRIP_SCHEMA, ZONE_SCHEMA


def conform(df: DataFrame, schema: T.StructType = TRIP_SCHEMA) -> DataFrame:
    """Cast the columns that ``schema`` names and keep all others.

    A column that already has its type is passed on as it is, so filters on it
    still reach the parquet reader. So is an integer of another width: a cast
    would keep filters on zones and codes from the reader.
    """
    wanted = {field.name: field.dataType for field in schema}

    def fits(got: T.DataType, want: T.DataType) -> bool:
        return got == want or (isinstance(got, T.IntegralType) and isinstance(want, T.IntegralType))

    return df.select(
        *[
            F.col(f"`{field.name}`").cast(wanted[field.name]).alias(field.name)
            if field.name in wanted and not fits(field.dataType, wanted[field.name])
            else F.col(f"`{field.name}`")
            for field in df.schema
        ]
    )


def read_trips(spark: SparkSession, path: str) -> DataFrame:
    """Trips from parquet with the preset's types; a missing path raises."""
    return conform(spark.read.parquet(path))


def write_trips(
    df: DataFrame,
    path: str,
    format: str = "parquet",
    partition_by: str | None = None,
    mode: str = "overwrite",
    rows_per_file: int = 0,
) -> None:
    """Write a table as parquet (S2) or, when asked for, as CSV with header (S3).

    With ``partition_by`` the rows are first rebalanced on that column:
    adaptive execution gives small values one file each and splits a value that
    holds a large share of the rows over many writers. ``rows_per_file`` bounds
    the rows of a file, 0 does not.
    """
    if partition_by:
        df = df.hint("rebalance", F.col(partition_by))
    writer = df.write.mode(mode).format(format).option("maxRecordsPerFile", rows_per_file)
    if format == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.save(path)


def preview(df: DataFrame, rows: int = 5, last: bool = False, order_by=(PICKUP_TIME,)) -> DataFrame:
    """First or last rows (S4). Row order is stated: ``order_by``, then every other column."""
    order = [*order_by, *[c for c in df.columns if c not in order_by]]
    keys = [F.col(f"`{c}`").desc() if last else F.col(f"`{c}`").asc() for c in order]
    return df.orderBy(*keys).limit(rows)


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """The zone dimension from CSV; ``N/A`` stays a text."""
    return spark.read.schema(ZONE_SCHEMA).csv(path, header=True)


def with_zone_names(
    trips: DataFrame, zones: DataFrame, zone: str = PICKUP_ZONE, zone_id: str = "LocationID"
) -> DataFrame:
    """Left join the zone dimension on its id.

    No broadcast hint: Spark sends the zones to every executor while their
    measured size is under its threshold and shuffles both sides beyond it,
    splitting a zone that holds too many trips.
    """
    return trips.join(zones, F.col(zone) == F.col(zone_id), "left")
