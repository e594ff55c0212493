"""Null tests, ratios, labels, rounding and trimming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curbmeter.schema import PAYMENT_NAMES, UNKNOWN_PAYMENT_PREFIX

FLOATS = (T.DoubleType, T.FloatType)
# Fixed value: the ASCII white space that text clean-up strips.
WHITE_SPACE = " \t\n\r\x0b\x0c"


def is_float(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, FLOATS)


def missing(df: DataFrame, column: str) -> Column:
    """True when the value is null or, in a float column, NaN."""
    value = F.col(f"`{column}`")
    return (value.isNull() | F.isnan(value)) if is_float(df, column) else value.isNull()


def nan_to_null(df: DataFrame, columns=None) -> DataFrame:
    """Turn NaN into null in the float columns; other columns are untouched."""
    names = [c for c in (columns or df.columns) if is_float(df, c)]
    return df.withColumns(
        {c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in names}
    )


def stripped(column) -> Column:
    """Text without white space at its ends."""
    return F.trim(column, F.lit(WHITE_SPACE))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """``part / whole`` in percent, null when ``whole`` is 0."""
    return F.bround(F.try_divide(part.cast("double"), whole.cast("double")) * 100.0, digits)


def mean(column, digits: int = 2) -> Column:
    """Mean rounded half-even, the rounding of the printed reports."""
    return F.bround(F.avg(column), digits)


def ratio_percent(numerator, denominator) -> Column:
    """Ratio in percent; null, not an error, for a zero denominator."""
    return F.try_divide(F.col(numerator), F.col(denominator)) * 100.0


def labelled(code: Column, names: dict, prefix: str) -> Column:
    """Name of a code, or ``prefix`` and the code when it has none."""
    pairs = [F.lit(part) for item in names.items() for part in item]
    return F.coalesce(
        F.try_element_at(F.create_map(*pairs), code.cast("int")),
        F.concat(F.lit(prefix), code.cast("string")),
    )


def payment_label(code) -> Column:
    """Report name of a payment code."""
    return labelled(F.col(code), PAYMENT_NAMES, UNKNOWN_PAYMENT_PREFIX)


def route_label(origin, destination) -> Column:
    """``区域a → 区域b``."""
    return F.format_string("区域%s → 区域%s", F.col(origin).cast("string"), F.col(destination).cast("string"))
