"""Errors, residuals and the comparison of models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbmeter.operators.sampling import histogram


def error_metrics(
    df: DataFrame, actual: str = "demand", predicted: str = "prediction"
) -> DataFrame:
    """Mean absolute error and root mean square error."""
    gap = F.col(actual) - F.col(predicted)
    return df.agg(
        F.count("*").alias("rows"),
        F.avg(F.abs(gap)).alias("mae"),
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
    )


def compare_models(scored: dict, actual: str = "demand") -> DataFrame:
    """Error per metric of two models, the better one and the gap in percent (M9).

    ``scored`` maps two model names to their predictions.
    """
    (first, a), (second, b) = (
        (name, error_metrics(df, actual).select(F.struct("mae", "rmse").alias("e")))
        for name, df in scored.items()
    )
    both = a.select(F.col("e").alias("a"), b.scalar().alias("b"))
    metrics = F.array(
        *[
            F.struct(
                F.lit(m.upper()).alias("metric"),
                F.col("a")[m].alias(first),
                F.col("b")[m].alias(second),
            )
            for m in ("mae", "rmse")
        ]
    )
    x, y = F.col(first), F.col(second)
    return both.select(F.inline(metrics)).select(
        "metric",
        first,
        second,
        F.when(x < y, first).otherwise(second).alias("better"),
        (F.try_divide(F.abs(x - y), F.greatest(x, y)) * 100.0).alias("difference_pct"),
    )


def with_residual(
    df: DataFrame, actual: str = "demand", predicted: str = "prediction"
) -> DataFrame:
    """Add actual minus predicted."""
    return df.withColumn("residual", F.col(actual) - F.col(predicted))


def residual_summary(df: DataFrame) -> DataFrame:
    """Number and mean of the residuals."""
    return df.agg(F.count("residual").alias("n"), F.avg("residual").alias("mean_residual"))


def residual_histogram(df: DataFrame, bins: int = 50) -> DataFrame:
    """Distribution of the residuals."""
    return histogram(df, "residual", bins)


def actual_predicted(
    df: DataFrame, actual: str = "demand", predicted: str = "prediction"
) -> DataFrame:
    """The pairs of the actual-against-predicted chart."""
    return df.select(F.col(actual).alias("actual"), F.col(predicted).alias("predicted"))


def actual_range(df: DataFrame, actual: str = "demand") -> DataFrame:
    """Ends of the diagonal of that chart."""
    return df.agg(F.min(actual).alias("low"), F.max(actual).alias("high"))


def stack_errors(scored: dict, actual: str = "demand") -> DataFrame:
    """Error metrics of any number of models, one row each."""
    return reduce(
        DataFrame.unionByName,
        [error_metrics(df, actual).withColumn("model", F.lit(name)) for name, df in scored.items()],
    )
