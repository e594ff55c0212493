"""Input tables of the registered queries.

Trips are derived from ``lineitem`` and cleaned once per session and data set;
both tables are written to the shared checkpoint folder. The queries read them
back like any user's trip files, pruned to their columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from curbmeter.operators.clean import clean, sparse_columns
from curbmeter.session import checkpoint_root
from curbmeter.sources.lineitem_trips import trips_from_lineitem
from curbmeter.sources.tables import read_trips, write_trips

# Rows of one derived file; a file is the least that a task reads.
FILE_ROWS = 100_000
_written: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stored(spark: SparkSession, sf_dir: str, name: str, build) -> str:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        path = f"{checkpoint_root(spark)}/trips-{uuid.uuid4().hex}/{name}"
        write_trips(build(), path, rows_per_file=FILE_ROWS)
        _written[key] = path
    return _written[key]


def stored_raw(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the derived raw trips."""

    def build() -> DataFrame:
        return trips_from_lineitem(table(spark, sf_dir, "lineitem"))

    return _stored(spark, sf_dir, "raw", build)


def raw_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_trips(spark, stored_raw(spark, sf_dir))


def cleaned_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        raw = raw_trips(spark, sf_dir)
        return clean(raw, drop=sparse_columns(raw))

    return read_trips(spark, _stored(spark, sf_dir, "cleaned", build))
