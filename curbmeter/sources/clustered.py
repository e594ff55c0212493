"""A layout of the trips in which a few row groups hold the rows of a zone, a route or a span of time (S2 for Q1, Q4, Q6).

Rows are sorted along a Morton curve: the bits of the scaled columns are
interleaved, so rows that are near in all of them are near in the file, and the
least and largest values that parquet keeps per row group are close to each
other in every column. Readers then skip row groups for a filter on any of the
columns, and most of them for a filter on several.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curbmeter.schema import DROPOFF_ZONE, PICKUP_TIME, PICKUP_ZONE
from curbmeter.session import PARTITION_BYTES, UNKNOWN_BYTES, estimated_bytes

# Bits per column; all together are at most 63.
BITS = 16
CLUSTER_COLUMNS = (PICKUP_ZONE, DROPOFF_ZONE, PICKUP_TIME)


def _number(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    value = F.col(f"`{column}`")
    if isinstance(kind, T.TimestampNTZType):
        value = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), value)
    elif isinstance(kind, T.TimestampType):
        value = F.unix_seconds(value)
    elif isinstance(kind, T.DateType):
        value = F.unix_date(value)
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


def curve_key(df: DataFrame, columns=CLUSTER_COLUMNS, bits: int = BITS) -> Column:
    """The place of a row on the curve through all values of ``columns``; nulls come first.

    Columns come in the order of their importance. They are scaled between their least
    and largest value, which takes one scan of these columns at the call.
    """
    bits = min(bits, 63 // len(columns))
    ends = [f(_number(df, c)).alias(f"{name}{i}") for i, c in enumerate(columns) for name, f in (("lo", F.min), ("hi", F.max))]
    row = df.agg(*ends).first()
    key = F.lit(0).cast("long")
    for i, column in enumerate(columns):
        low, high = row[f"lo{i}"], row[f"hi{i}"]
        if low is None or low == high:
            continue
        share = (_number(df, column) - F.lit(low)) / F.lit(high - low)
        place = F.coalesce(F.least(F.floor(share * (1 << bits)), F.lit((1 << bits) - 1)), F.lit(0)).cast("long")
        for bit in range(bits):
            one = F.shiftright(place, bit).bitwiseAND(F.lit(1).cast("long"))
            # Of each level the first column's bit counts most.
            key = key.bitwiseOR(F.shiftleft(one, bit * len(columns) + len(columns) - 1 - i))
    return key


def write_clustered(
    df: DataFrame,
    path: str,
    columns=CLUSTER_COLUMNS,
    files: int | None = None,
    group_bytes: int | None = None,
    mode: str = "overwrite",
) -> None:
    """Write ``df`` as parquet along the curve through ``columns``.

    ``files`` is one per 128 MB of the plan's size estimate if not given;
    ``group_bytes`` sets the size of row groups. The rows are those of ``df``;
    only their order changes. A range of the curve is a task's share, so a value
    that holds a third of all rows is spread by the other columns; rows that are
    equal in all of them stay together.
    """
    if files is None:
        size = estimated_bytes(df)
        files = max(1, -(-size // PARTITION_BYTES)) if size < UNKNOWN_BYTES else None
    key = curve_key(df, columns).alias("_curve")
    placed = df.select("*", key)
    ranged = placed.repartitionByRange(files, "_curve") if files else placed.repartitionByRange("_curve")
    writer = ranged.sortWithinPartitions("_curve").drop("_curve").write.mode(mode)
    if group_bytes:
        writer = writer.option("parquet.block.size", group_bytes)
    writer.parquet(path)
