"""Cleaning (C1-C10).

A rule is one expression that is true for the rows to keep. The filter joins
all rules with AND, so Catalyst pushes the single-column ones to the parquet
reader; the funnel turns the same expressions into the reason of rejection and
counts them in one pass instead of one pass per rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbmeter.functions.values import is_float, missing, nan_to_null, percent, stripped
from curbmeter.operators.audit import Audit, per_column
from curbmeter.operators.duplicates import distinct_rows
from curbmeter.schema import (
    BAD_PAYMENTS,
    BAD_RATES,
    BAD_VENDORS,
    DISTANCE,
    DROPOFF_TIME,
    FARE,
    GOOD_FLAGS,
    KEY_COLUMNS,
    PASSENGERS,
    PAYMENT,
    PICKUP_TIME,
    RATE_CODE,
    STORE_FLAG,
    TOTAL,
    VENDOR,
)

MISSING, OUTLIER, CATEGORY = "missing", "outlier", "category"
KEPT = "10 kept"


@dataclass(frozen=True)
class Rule:
    """``keep`` is true exactly for the rows that pass."""

    reason: str
    kind: str
    keep: Column


def present(df: DataFrame, columns) -> list:
    """The columns of the list that the table has."""
    return [c for c in columns if c in df.columns]


def has_keys(df: DataFrame, keys=KEY_COLUMNS) -> Column:
    """No key is missing."""
    keep = F.lit(True)
    for key in present(df, keys):
        keep = keep & F.col(key).isNotNull()
        if is_float(df, key):
            keep = keep & ~F.isnan(key)
    return keep


def positive(column: str) -> Column:
    """Above zero, or not known (C4)."""
    return F.col(column).isNull() | (F.col(column) > 0)


def none_of(column: str, codes) -> Column:
    """Not one of the bad codes; a missing code is no reason to reject."""
    return F.col(column).isNull() | ~F.col(column).isin(*codes)


def trip_rules(df: DataFrame, keys=KEY_COLUMNS) -> list:
    """The trip rules in the order in which they are charged; absent columns have none."""
    names = set(df.columns)
    rules = [Rule("01 missing key", MISSING, has_keys(df, keys))]
    for reason, column in (
        ("02 distance not positive", DISTANCE),
        ("03 fare not positive", FARE),
        ("04 passengers not positive", PASSENGERS),
    ):
        if column in names:
            rules.append(Rule(reason, OUTLIER, positive(column)))
    if {PICKUP_TIME, DROPOFF_TIME} <= names:
        later = F.col(DROPOFF_TIME) > F.col(PICKUP_TIME)
        rules.append(Rule("05 dropoff not after pickup", OUTLIER, F.coalesce(later, F.lit(True))))
    for reason, column, codes in (
        ("06 payment code", PAYMENT, BAD_PAYMENTS),
        ("07 rate code", RATE_CODE, BAD_RATES),
        ("08 vendor code", VENDOR, BAD_VENDORS),
    ):
        if column in names:
            rules.append(Rule(reason, CATEGORY, none_of(column, codes)))
    if STORE_FLAG in names:
        flag = F.coalesce(stripped(STORE_FLAG).isin(*GOOD_FLAGS), F.lit(False))
        rules.append(Rule("09 store flag", CATEGORY, flag))
    return rules


def keep_valid(df: DataFrame, rules: list | None = None) -> DataFrame:
    """Apply the rules and strip the flag.

    Stateless, so it works on a streaming DataFrame as well.
    """
    for rule in rules or trip_rules(df):
        df = df.where(rule.keep)
    if STORE_FLAG in df.columns:
        df = df.withColumn(STORE_FLAG, stripped(STORE_FLAG))
    return df


def sparse_audit(df: DataFrame, keys=KEY_COLUMNS, limit: float = 0.5) -> Audit:
    """Names of the non-key columns that are missing in more than ``limit`` of the keyed rows."""
    keyed = has_keys(df, keys)
    return per_column(
        [c for c in df.columns if c not in keys],
        {"absent": lambda c: F.count_if(keyed & missing(df, c))},
        {"keyed": F.count_if(keyed)},
        lambda rows: rows.where(
            F.try_divide(F.col("absent").cast("double"), F.col("keyed")) > limit
        ).select("column"),
    )


def sparse_columns(df: DataFrame, keys=KEY_COLUMNS, limit: float = 0.5) -> list:
    """Non-key columns that are missing in more than ``limit`` of the rows with all keys.

    The result shapes the schema of everything after it, so this runs one job;
    it returns at most one row per column.
    """
    return [row["column"] for row in sparse_audit(df, keys, limit).of(df).collect()]


def clean(df: DataFrame, keys=KEY_COLUMNS, drop: list | None = None) -> DataFrame:
    """The cleaned table.

    ``drop`` names the sparse columns when they are already known, which saves
    a job. The de-duplication of a large table compares fingerprints of all rows
    at the call and whole rows only where a fingerprint occurs again, so it moves
    8 bytes and a count per row.
    """
    if drop is None:
        drop = sparse_columns(df, keys)
    return distinct_rows(nan_to_null(keep_valid(df, trip_rules(df, keys)).drop(*drop)))


def consistency_counts(total: str = TOTAL, fare: str = FARE) -> Audit:
    below = F.count_if(F.col(total) < F.col(fare))
    return Audit(
        {
            "rows": F.count("*"),
            "total_below_fare": below,
            "rate_pct": percent(below, F.count("*")),
        },
        lambda one: one,
    )


def fare_consistency(df: DataFrame, total: str = TOTAL, fare: str = FARE) -> DataFrame:
    """Rows whose total is under the fare; they are reported, not removed."""
    return consistency_counts(total, fare).of(df)


def with_reason(df: DataFrame, rules: list | None = None) -> DataFrame:
    """Add ``reason``: the first broken rule, or that the row is kept."""
    reason = F
    for rule in rules or trip_rules(df):
        reason = reason.when(~rule.keep, F.lit(rule.reason))
    return df.withColumn("reason", reason.otherwise(F.lit(KEPT)))


def reject_funnel(df: DataFrame, rules: list | None = None) -> DataFrame:
    """Rows per reason, each row charged to the first rule it breaks."""
    return with_reason(df, rules).groupBy("reason").agg(F.count("*").alias("rows"))


def funnel_audit(rules: list) -> Audit:
    """The same from one row of counts, for rows that have their reason."""
    reasons = [*[rule.reason for rule in rules], KEPT]
    return per_column(
        reasons,
        {"rows": lambda reason: F.count_if(F.col("reason") == reason)},
        {},
        lambda rows: rows.where(F.col("rows") > 0).withColumnRenamed("column", "reason"),
    )


def removal_counts(df: DataFrame, keys=KEY_COLUMNS) -> dict:
    """Aggregates over rows that have their reason: all rows, removed per kind, kept."""
    rules = trip_rules(df, keys)

    def of_kind(kind: str) -> Column:
        return F.count_if(F.col("reason").isin(*[r.reason for r in rules if r.kind == kind]))

    return {
        "rows_before": F.count("*"),
        "removed_missing": of_kind(MISSING),
        "removed_outlier": of_kind(OUTLIER),
        "removed_category": of_kind(CATEGORY),
        "kept": F.count_if(F.col("reason") == KEPT),
    }


def clean_stats(df: DataFrame, keys=KEY_COLUMNS, drop: list | None = None) -> DataFrame:
    """One row: rows before and after and rows removed per kind of rule."""
    after = clean(df, keys, drop).agg(F.count("*")).scalar()
    counts = [value.alias(name) for name, value in removal_counts(df, keys).items()]
    return with_reason(df, trip_rules(df, keys)).agg(*counts).select(
        "rows_before",
        after.alias("rows_after"),
        "removed_missing",
        "removed_outlier",
        "removed_category",
        (F.col("kept") - after).alias("removed_duplicate"),
    )
