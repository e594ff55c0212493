"""Trips of several months whose files differ in their columns.

Months come with other types for the same column - codes as INT, BIGINT or
DOUBLE - and other spellings of its name. Reading them as one table with one
schema fails or turns columns to null. Here paths of one physical schema are one
scan with that schema; each scan is renamed and cast to the preset, and the
scans are a union. Filters reach every scan: Catalyst turns a comparison of a
widened column into one of the stored column.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curbmeter.schema import TRIP_SCHEMA

# Footers that are read at once.
READERS = 16


def physical_schemas(spark: SparkSession, paths) -> dict:
    """The paths of each stored schema, in order; a path is a file, or a folder of files written together.

    Reads one footer per path; no rows, and nothing about a path comes to the
    driver but its schema.
    """
    paths = list(paths)
    with ThreadPoolExecutor(READERS) as readers:
        schemas = list(readers.map(lambda path: spark.read.parquet(path).schema, paths))
    found: dict = {}
    for path, schema in zip(paths, schemas):
        found.setdefault(schema.json(), (schema, []))[1].append(path)
    return {key: value for key, value in found.items()}


def _kind(types: list, wanted: T.DataType | None) -> T.DataType | None:
    """The type in which all stored types of a column fit; None where they are one type already."""
    if all(t == types[0] for t in types) and (wanted is None or types[0] == wanted or _whole(types[0]) and _whole(wanted)):
        return None
    # Whole numbers are widened among themselves, so that filters on ids and codes reach the readers.
    if all(_whole(t) for t in types) and (wanted is None or _whole(wanted)):
        return T.LongType()
    if wanted is not None:
        return wanted
    if all(isinstance(t, T.NumericType) for t in types):
        return T.DoubleType()
    return T.StringType()


def _whole(kind: T.DataType) -> bool:
    return isinstance(kind, T.IntegralType)


def read_months(spark: SparkSession, paths, schema: T.StructType = TRIP_SCHEMA, file_column: str | None = None) -> DataFrame:
    """All paths as one table: the columns of ``schema`` that any path has, then all others.

    Names are matched without regard to case and spelled as in ``schema``, or
    else as where they first occur. A column that a path lacks is null there. A
    column that ``schema`` names gets its type, except that whole numbers stay
    whole (BIGINT, if their widths differ); others get one that fits all paths. A path
    with two spellings of one name is an error, as is an empty list. ``file_column``
    names a further column with the path of a row's file.
    """
    groups = list(physical_schemas(spark, paths).values())
    if not groups:
        raise ValueError("no paths to read")
    wanted = {field.name.lower(): field for field in schema}
    names, kinds = {}, {}
    for stored, group in groups:
        if len({c.lower() for c in stored.names}) < len(stored.names):
            raise ValueError(f"columns that differ in case only: {group[0]}")
        for field in stored:
            low = field.name.lower()
            names.setdefault(low, wanted[low].name if low in wanted else field.name)
            kinds.setdefault(low, []).append(field.dataType)
    casts = {low: _kind(kinds[low], wanted[low].dataType if low in wanted else None) for low in kinds}
    order = [low for low in wanted if low in names] + [low for low in names if low not in wanted]

    def scan(stored: T.StructType, group: list) -> DataFrame:
        has = {field.name.lower(): field for field in stored}
        columns = []
        for low in order:
            if low not in has:
                value = F.lit(None).cast(casts[low] or kinds[low][0])
            else:
                value = F.col(f"`{has[low].name}`")
                if casts[low] is not None and has[low].dataType != casts[low]:
                    value = value.cast(casts[low])
            columns.append(value.alias(names[low]))
        if file_column:
            columns.append(F.col("_metadata.file_path").alias(file_column))
        return spark.read.schema(stored).parquet(*group).select(*columns)

    return reduce(DataFrame.unionAll, [scan(stored, group) for stored, group in groups])
