"""Profiling and quality audit.

Every audit is one aggregation over the columns it names; the per-column
numbers of that single row are then turned into rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curbmeter.functions.values import FLOATS, is_float, missing, nan_to_null, percent, stripped
from curbmeter.operators.audit import Audit, per_column
from curbmeter.operators.buckets import (
    OPEN,
    Distribution,
    above,
    below,
    fence_brackets,
    fences,
    local_table,
    moments,
)
from curbmeter.operators.clean import clean, present, removal_counts, with_reason
from curbmeter.operators.demand import with_key
from curbmeter.operators.duplicates import WHOLE_BYTES, extra_rows
from curbmeter.operators.quantiles import quantiles, quartile_columns
from curbmeter.schema import (
    CODE_DOMAINS,
    DROPOFF_TIME,
    IQR_COLUMNS,
    KEY_COLUMNS,
    PASSENGERS,
    PICKUP_TIME,
    SIGN_COLUMNS,
    STORE_FLAG,
    UNKNOWN_MEANING,
    code_table,
)

TIMES = (T.TimestampType, T.TimestampNTZType)


def columns_of_kind(df: DataFrame, kind: str) -> list:
    """Names of the numeric, text or datetime columns."""
    classes = {"numeric": T.NumericType, "text": T.StringType, "datetime": TIMES}
    return [f.name for f in df.schema if isinstance(f.dataType, classes[kind])]


def schema_profile(df: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Position, name, type and kind of each column with the row count.

    ``rows`` is a one-row table with the column ``rows`` where they were counted before.
    """
    kinds = {c: k for k in ("numeric", "text", "datetime") for c in columns_of_kind(df, k)}
    described = [
        (i, name, dtype, kinds.get(name, "other")) for i, (name, dtype) in enumerate(df.dtypes)
    ]
    rows = df.agg(F.count("*").alias("rows")) if rows is None else rows
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(name).alias("column"),
                F.lit(dtype).alias("type"),
                F.lit(kind).alias("kind"),
            )
            for i, name, dtype, kind in described
        ]
    )
    return rows.select("rows", F.inline(entries))


def null_audit(df: DataFrame, columns=None, only_nulls: bool = True) -> Audit:
    def render(counts: DataFrame) -> DataFrame:
        if only_nulls:
            counts = counts.where(F.col("nulls") > 0)
        return counts.select(
            "column", "nulls", percent(F.col("nulls"), F.col("rows")).alias("rate_pct")
        ).orderBy(F.desc("rate_pct"), "column")

    return per_column(
        columns or df.columns,
        {"nulls": lambda c: F.count_if(missing(df, c))},
        {"rows": F.count("*")},
        render,
    )


def null_profile(df: DataFrame, columns=None, only_nulls: bool = True) -> DataFrame:
    """Missing values per column and their rate, highest rate first."""
    return null_audit(df, columns, only_nulls).of(df)


def key_null_profile(df: DataFrame, keys=KEY_COLUMNS) -> DataFrame:
    """Missing values per key column, columns without any included."""
    return null_profile(df, present(df, keys), only_nulls=False)


def null_column_count(df: DataFrame) -> DataFrame:
    """Number of columns with missing values."""
    return null_profile(df).agg(F.count("*").alias("columns_with_nulls"))


def worst_null_columns(df: DataFrame, top: int = 15) -> DataFrame:
    """The columns with the highest missing rates (P5)."""
    return null_profile(df).orderBy(F.desc("rate_pct"), "column").limit(top)


def _finite(df: DataFrame, column: str) -> Column:
    value = F.col(f"`{column}`")
    return F.when(~F.isnan(value), value) if is_float(df, column) else value


def basics_audit(df: DataFrame, columns) -> Audit:
    """Count, mean, sample deviation and extremes per column."""
    return per_column(
        columns,
        {
            "count": lambda c: F.count(_finite(df, c)),
            "mean": lambda c: F.avg(_finite(df, c)),
            "std": lambda c: F.stddev_samp(_finite(df, c)),
            "min": lambda c: F.min(_finite(df, c)).cast("double"),
            "max": lambda c: F.max(_finite(df, c)).cast("double"),
        },
        {},
        lambda rows: rows,
    )


def quartile_table(
    df: DataFrame, columns, by=(), few_groups: bool = False, exact: bool = True
) -> DataFrame:
    """One row per column (and group) with ``q1``, ``median`` and ``q3``."""
    found = quantiles(df, columns, (0.25, 0.5, 0.75), by, few_groups, exact)
    return quartile_columns(found, {0.25: "q1", 0.5: "median", 0.75: "q3"}, by)


DESCRIBED = T.StructType(
    [T.StructField("column", T.StringType()), T.StructField("count", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")]
)
QUARTILES = (0.25, 0.5, 0.75)


def described(known: Distribution) -> DataFrame:
    """The report on the columns of a state: moments from it, quartiles from one scan of the buckets they lie in."""
    asked = [([(c,)], p, None) for c in known.columns if (c,) in known.parts for p in QUARTILES]
    for keys, p, _ in asked:
        known.want_quantile(keys, p)
    known.read()
    found = dict(zip([(keys[0][0], p) for keys, p, _ in asked], known.quantiles(asked)))
    rows = []
    for c in known.columns:
        count, mean, std, low, high = moments(known.parts[(c,)]) if (c,) in known.parts else (0, None, None, None, None)
        rows.append((c, count, mean, std, low, *[found.get((c, p)) for p in QUARTILES], high))
    return local_table(known.df.sparkSession, rows, DESCRIBED)


def describe(
    df: DataFrame,
    columns=None,
    exact: bool = True,
    basics: DataFrame | None = None,
    quartiles: DataFrame | None = None,
) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles per numeric column.

    The exact form takes two scans, at the call: the bucket state has the
    moments, and tells what to read for the quartiles. ``basics`` and
    ``quartiles`` can be passed when they are already computed.
    """
    columns = list(columns or columns_of_kind(df, "numeric"))
    if exact and basics is None and quartiles is None:
        return described(Distribution(df, columns))
    basics = basics if basics is not None else basics_audit(df, columns).of(df)
    if quartiles is None:
        quartiles = quartile_table(df, columns, exact=exact)
    # Both sides have one row per named column.
    return basics.join(F.broadcast(quartiles), "column", "left").select(
        "column", "count", "mean", "std", "min",
        F.col("q1").alias("q25"), F.col("median").alias("q50"), F.col("q3").alias("q75"), "max",
    )


def outlier_counts(df: DataFrame, columns, quartiles: dict) -> Audit:
    """Values beyond the bounds of ``quartiles``, which maps a column to (q1, q3)."""
    fields = ("q1", "q3", "iqr", "lower", "upper")
    limits = {}
    for c in columns:
        q1, q3 = quartiles.get(c, (None, None))
        spread = None if q1 is None else q3 - q1
        known = (None,) * 5 if q1 is None else (q1, q3, spread, q1 - 1.5 * spread, q3 + 1.5 * spread)
        limits[c] = dict(zip(fields, [F.lit(v).cast("double") for v in known]))

    def outside(c: str) -> Column:
        value = _finite(df, c)
        return F.count_if((value < limits[c]["lower"]) | (value > limits[c]["upper"]))

    return per_column(
        columns,
        {**{f: (lambda c, f=f: F.max(limits[c][f])) for f in fields}, "outliers": outside},
        {"rows": F.count("*")},
        lambda rows: rows.select(
            "column", *fields, "outliers", percent(F.col("outliers"), F.col("rows")).alias("rate_pct")
        ),
    )


def iqr_columns(df: DataFrame, columns=IQR_COLUMNS) -> list:
    """Those of the columns that the table has as numbers."""
    return [c for c in present(df, columns) if c in columns_of_kind(df, "numeric")]


def quartile_numbers(quartiles: DataFrame) -> dict:
    """Quartiles per column on the driver: one row per named column."""
    return {row["column"]: (row["q1"], row["q3"]) for row in quartiles.collect()}


OUTSIDE = T.StructType(
    [T.StructField("column", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in ("q1", "q3", "iqr", "lower", "upper")]
    + [T.StructField(c, T.LongType()) for c in ("outliers", "rows")]
)


def iqr_audit(df: DataFrame, columns=IQR_COLUMNS, exact: bool = True) -> DataFrame:
    """Values outside the bounds per column, with their rate among all rows.

    The exact form takes two scans, at the call: with the buckets of the
    quartiles it reads those in which the bounds can lie. The other form finds
    the quartiles first; as literals they let one pass count the outliers.
    """
    columns = iqr_columns(df, columns)
    if not exact:
        quartiles = quartile_numbers(quartile_table(df, columns, exact=False))
        return outlier_counts(df, columns, quartiles).of(df)
    known = Distribution(df, columns)
    present_ = [c for c in columns if (c,) in known.parts]
    for c in present_:
        brackets = fence_brackets(known.want_quantile([(c,)], 0.25), known.want_quantile([(c,)], 0.75))
        for bracket in brackets:
            known.want_range([(c,)], *bracket)
    known.read()
    found = known.quantiles([([(c,)], p, None) for c in present_ for p in (0.25, 0.75)])
    quartiles = dict(zip(present_, zip(found[::2], found[1::2])))
    bounds = {c: fences(*quartiles[c]) for c in present_}
    asked = [([(c,)], *ends) for c, (_, lower, upper) in bounds.items() for ends in ((-OPEN, below(lower)), (above(upper), OPEN))]
    counts = [n for n, *_ in known.within(asked)]
    outliers = {c: a + b for c, a, b in zip(present_, counts[::2], counts[1::2])}
    total = df.count()
    rows = [(c, *quartiles.get(c, (None, None)), *bounds.get(c, (None,) * 3), outliers.get(c, 0), total) for c in columns]
    return local_table(df.sparkSession, rows, OUTSIDE).select(
        "column", "q1", "q3", "iqr", "lower", "upper", "outliers", percent(F.col("outliers"), F.col("rows")).alias("rate_pct")
    )


def sign_counts(df: DataFrame, columns=SIGN_COLUMNS) -> Audit:
    return per_column(
        present(df, columns),
        {
            "negative": lambda c: F.count_if(F.col(c) < 0),
            "zero": lambda c: F.count_if(F.col(c) == 0),
        },
        {"rows": F.count("*")},
        lambda rows: rows.select(
            "column",
            "negative",
            percent(F.col("negative"), F.col("rows")).alias("negative_pct"),
            "zero",
            percent(F.col("zero"), F.col("rows")).alias("zero_pct"),
        ),
    )


def sign_audit(df: DataFrame, columns=SIGN_COLUMNS) -> DataFrame:
    """Negative and zero values per column."""
    return sign_counts(df, columns).of(df)


def failures(condition: Column, name: str = "invalid") -> Audit:
    """Rows where the condition is true, with their rate."""
    return Audit(
        {
            name: F.count_if(condition),
            "rate_pct": percent(F.count_if(condition), F.count("*")),
        },
        lambda one: one,
    )


def passenger_validity(df: DataFrame, column: str = PASSENGERS) -> DataFrame:
    """Rows without passengers."""
    return failures(F.col(column) <= 0).of(df)


def time_order_audit(
    df: DataFrame, pickup_time: str = PICKUP_TIME, dropoff_time: str = DROPOFF_TIME
) -> DataFrame:
    """Rows that end no later than they begin."""
    return failures(F.col(dropoff_time) <= F.col(pickup_time)).of(df)


def value_distribution(df: DataFrame, column: str = PASSENGERS) -> DataFrame:
    """Rows per value in value order, missing values left out (P10)."""
    return (
        df.where(~missing(df, column))
        .groupBy(column)
        .agg(F.count("*").alias("rows"))
        .orderBy(column)
    )


def _domains(df: DataFrame, domains) -> list:
    return [d for d in domains if d.column in df.columns]


def domain_summary(df: DataFrame, domains=CODE_DOMAINS, counts: DataFrame | None = None) -> DataFrame:
    """Total, missing, present and distinct values per code column.

    Counts the value table of :func:`domain_values`, which is small: a plain
    distinct count of several columns would first multiply every row. The domain
    reports take that table as ``counts`` where it was made before.
    """
    values = code_counts(df, domains) if counts is None else counts
    return values.groupBy("column").agg(
        F.sum("rows").alias("rows"),
        F.sum(F.when(F.col("value").isNull(), F.col("rows")).otherwise(0)).alias("nulls"),
        F.count("value").alias("distinct_values"),
    ).select(
        "column",
        "rows",
        "nulls",
        percent(F.col("nulls"), F.col("rows")).alias("null_pct"),
        (F.col("rows") - F.col("nulls")).alias("non_null"),
        "distinct_values",
    )


def _code_text(df: DataFrame, column: str) -> Column:
    """A code as text; whole numbers lose the fraction, so 99.0 and 99 are one code."""
    value = F.col(column)
    if isinstance(df.schema[column].dataType, FLOATS):
        whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
        return F.when(F.isnan(value), None).when(
            whole, value.cast("decimal(20,0)").cast("string")
        ).otherwise(value.cast("string"))
    return value.cast("string")


def code_counts(df: DataFrame, domains=CODE_DOMAINS) -> DataFrame:
    """Rows per code column and value, the missing value included."""
    return text_counts(df, [d.column for d in _domains(df, domains)])


def text_counts(df: DataFrame, columns: list, by=()) -> DataFrame:
    """Rows per column (and group) and value as text, the missing value included."""
    texts = df.select(*by, *[_code_text(df, c).alias(c) for c in columns])
    return (
        texts.unpivot(list(by), columns, "column", "value")
        .groupBy(*by, "column", "value")
        .agg(F.count("*").alias("rows"))
    )


def domain_values(df: DataFrame, domains=CODE_DOMAINS, counts: DataFrame | None = None) -> DataFrame:
    """Every value of the code columns: rows, share, meaning, in or out of the domain.

    Membership of a trimmed domain looks at the stripped value, the rows are
    those of the raw value. The data dictionary is a fixed list of a few dozen
    rows and is broadcast.
    """
    known = _domains(df, domains)
    dictionary = F.broadcast(code_table(df.sparkSession, known))
    trimmed = [d.column for d in known if d.trimmed]
    counts = code_counts(df, domains) if counts is None else counts
    sizes = counts.groupBy("column").agg(F.sum("rows").alias("all_rows"))
    value = F.when(F.col("column").isin(*trimmed), stripped("value")).otherwise(F.col("value"))
    standard = dictionary.where("is_standard").select(
        F.col("column"), F.col("value").alias("lookup"), F.lit(True).alias("is_standard")
    )
    meanings = dictionary.select("column", "value", "meaning")
    return (
        with_key(counts, "value", "rows")
        # One size row per code column.
        .join(F.broadcast(sizes), "column")
        .withColumn("lookup", value)
        .join(standard, ["column", "lookup"], "left")
        .join(meanings, ["column", "value"], "left")
        .select(
            "column",
            "value",
            "rows",
            percent(F.col("rows"), F.col("all_rows")).alias("share_pct"),
            F.coalesce("is_standard", F.lit(False)).alias("is_standard"),
            F.coalesce(
                "meaning", F.when(F.col("is_standard"), F.lit("")).otherwise(UNKNOWN_MEANING)
            ).alias("meaning"),
        )
        .orderBy("column", F.desc("is_standard"), "value")
    )


def domain_anomalies(df: DataFrame, domains=CODE_DOMAINS, counts: DataFrame | None = None) -> DataFrame:
    """Rows with a value out of the domain per code column, 0 when there are none."""
    known = _domains(df, domains)
    standard = code_table(df.sparkSession, known).where("is_standard")
    trimmed = [d.column for d in known if d.trimmed]
    lookup = F.when(F.col("column").isin(*trimmed), stripped("value")).otherwise(F.col("value"))
    allowed = standard.select(
        "column", F.col("value").alias("lookup"), F.lit(True).alias("is_standard")
    )
    bad = F.sum(
        F.when(F.col("value").isNotNull() & F.col("is_standard").isNull(), F.col("rows"))
        .otherwise(0)
    )
    return (
        (code_counts(df, domains) if counts is None else counts)
        .withColumn("lookup", lookup)
        .join(F.broadcast(allowed), ["column", "lookup"], "left")
        .groupBy("column")
        .agg(bad.alias("anomalous"), percent(bad, F.sum("rows")).alias("rate_pct"))
    )


def domain_anomaly_total(df: DataFrame, domains=CODE_DOMAINS, counts: DataFrame | None = None) -> DataFrame:
    """Anomalous values over all code columns; a row bad twice counts twice."""
    return domain_anomalies(df, domains, counts).agg(
        F.coalesce(F.sum("anomalous"), F.lit(0)).alias("anomalous")
    )


def padding_counts(column: str = STORE_FLAG) -> Audit:
    text = F.col(column).cast("string")
    return Audit(
        {
            "leading": F.count_if(F.startswith(text, F.lit(" "))),
            "trailing": F.count_if(F.endswith(text, F.lit(" "))),
        },
        lambda one: one,
    )


def padding_audit(df: DataFrame, column: str = STORE_FLAG) -> DataFrame:
    """Values that begin or end with a blank."""
    return padding_counts(column).of(df)


def duplicate_count(df: DataFrame, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """Rows that repeat an earlier row in every column, missing equal to missing.

    Exact, and beyond ``whole_bytes`` in two phases: fingerprints of all rows are
    shuffled, and only rows whose fingerprint occurs again are compared in full.
    """
    df = nan_to_null(df)
    rows = df.agg(F.count("*")).scalar()
    return extra_rows(df, whole_bytes=whole_bytes).select("duplicates", percent(F.col("duplicates"), rows).alias("rate_pct"))


def report_counts(df: DataFrame, keys=KEY_COLUMNS) -> Audit:
    """What the quality report needs of the uncleaned rows, which must have their reason."""
    removed = removal_counts(df, keys)
    nulls = {f"nulls_{i}": F.count_if(missing(df, c)) for i, c in enumerate(df.columns)}
    with_nulls = sum((F.col(n) > 0).cast("int") for n in nulls)
    return Audit(
        {**removed, **nulls},
        lambda one: one.select(
            *removed, F.lit(len(df.columns)).alias("columns"), with_nulls.alias("with_nulls")
        ),
    )


def quality_table(counts: DataFrame, rows_after) -> DataFrame:
    """The eight numbers as rows; ``rows_after`` is a number or a scalar column."""
    after = rows_after if isinstance(rows_after, Column) else F.lit(rows_after)
    numbers = {
        "01 rows before": F.col("rows_before"),
        "02 columns before": F.col("columns"),
        "03 columns with nulls": F.col("with_nulls"),
        "04 rows removed for missing keys": F.col("removed_missing"),
        "05 rows removed as outliers": F.col("removed_outlier"),
        "06 rows removed as duplicates": F.col("kept") - F.col("after"),
        "07 rows after": F.col("after"),
        "08 completeness pct": percent(F.col("after"), F.col("rows_before")),
    }
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"))
            for name, value in numbers.items()
        ]
    )
    return counts.withColumn("after", after).select(F.inline(entries))


def quality_report(df: DataFrame, drop: list | None = None) -> DataFrame:
    """The eight numbers of the quality report as ``(metric, value)``."""
    counts = report_counts(df).of(with_reason(df))
    return quality_table(counts, clean(df, drop=drop).agg(F.count("*")).scalar())
