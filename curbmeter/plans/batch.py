"""The batch run: audit, clean, save, report (and read back for the analyses)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbmeter.operators import clean as cleaning
from curbmeter.operators import profile
from curbmeter.operators.audit import run_together
from curbmeter.schema import (
    DROPOFF_TIME,
    KEY_COLUMNS,
    PASSENGERS,
    PICKUP_TIME,
    STORE_FLAG,
)
from curbmeter.session import cut_lineage
from curbmeter.sources.tables import preview, read_trips, write_trips


@dataclass
class BatchResult:
    """The cleaned table, as read from where it was written, and the report tables."""

    cleaned: DataFrame
    reports: dict


def counting_audits(raw: DataFrame, quartiles: DataFrame) -> dict:
    """Every audit that is a count; together they take one scan."""
    rules = cleaning.trip_rules(raw)
    numbers = profile.quartile_numbers(quartiles)
    return {
        "iqr": profile.outlier_counts(raw, profile.iqr_columns(raw), numbers),
        "nulls": profile.null_audit(raw),
        "key_nulls": profile.null_audit(raw, cleaning.present(raw, KEY_COLUMNS), False),
        "signs": profile.sign_counts(raw),
        "passengers": profile.failures(F.col(PASSENGERS) <= 0),
        "time_order": profile.failures(F.col(DROPOFF_TIME) <= F.col(PICKUP_TIME)),
        "padding": profile.padding_counts(STORE_FLAG),
        "consistency": cleaning.consistency_counts(),
        "basics": profile.basics_audit(raw, profile.columns_of_kind(raw, "numeric")),
        "sparse": cleaning.sparse_audit(raw),
        "rejected": cleaning.funnel_audit(rules),
        "totals": profile.report_counts(raw),
    }


def distribution_audits(raw: DataFrame, basics: DataFrame, quartiles: DataFrame, rows: DataFrame) -> dict:
    """The audits that need more than counts; those of code columns share one small table of values."""
    numeric = profile.columns_of_kind(raw, "numeric")
    codes = cut_lineage(profile.code_counts(raw))
    return {
        "schema": profile.schema_profile(raw, rows),
        "first_rows": preview(raw),
        "last_rows": preview(raw, last=True),
        "describe": profile.describe(raw, numeric, basics=basics, quartiles=quartiles),
        "passenger_counts": profile.value_distribution(raw),
        "domains": profile.domain_summary(raw, counts=codes),
        "domain_values": profile.domain_values(raw, counts=codes),
        "domain_anomalies": profile.domain_anomalies(raw, counts=codes),
        "anomaly_total": profile.domain_anomaly_total(raw, counts=codes),
        "duplicates": profile.duplicate_count(raw),
    }


def run_batch(
    spark: SparkSession,
    source: str,
    target: str,
    format: str = "parquet",
    partition_by: str | None = None,
) -> BatchResult:
    """Read ``source``, write the cleaned table to ``target`` and prepare all reports.

    One scan counts everything that can be counted, the outliers and sparse
    columns included; the quartiles are found once for two reports. The rows after cleaning are counted in the written table. The
    analyses read that table too: it is pruned to the columns they use, and the
    costly de-duplication is not repeated for each of them.
    """
    raw = read_trips(spark, source)
    numeric = profile.columns_of_kind(raw, "numeric")
    quartiles = cut_lineage(profile.quartile_table(raw, numeric))
    reports = run_together(cleaning.with_reason(raw), counting_audits(raw, quartiles))
    totals, basics = reports.pop("totals"), reports.pop("basics")
    drop = [row["column"] for row in reports["sparse"].collect()]
    write_trips(cleaning.clean(raw, drop=drop), target, format, partition_by)

    reader = spark.read
    if format == "csv":
        kept = [field for field in raw.schema if field.name not in drop]
        reader = reader.option("header", True).schema(type(raw.schema)(kept))
    cleaned = reader.format(format).load(target)
    reports["quality"] = profile.quality_table(totals, cleaned.count())
    reports["null_columns"] = reports["nulls"].agg(F.count("*").alias("columns_with_nulls"))
    rows = totals.select(F.col("rows_before").alias("rows"))
    reports.update(distribution_audits(raw, basics, quartiles, rows))
    return BatchResult(cleaned, reports)
