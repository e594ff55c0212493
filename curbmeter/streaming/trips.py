"""Cleaning rules and time features on a stream of trips.

Both are row by row, so the batch functions run unchanged on a streaming
DataFrame and need neither watermark nor state. De-duplication over all rows
and sparse columns need the whole table and stay with the batch run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from curbmeter.functions.timing import with_time_features
from curbmeter.operators.clean import keep_valid
from curbmeter.schema import TRIP_SCHEMA


def read_trip_stream(
    spark: SparkSession, folder: str, schema=TRIP_SCHEMA, files_per_trigger: int | None = None
) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def valid_trips_with_features(stream: DataFrame) -> DataFrame:
    """Trips that pass every rule, with their time features."""
    return with_time_features(keep_valid(stream))
