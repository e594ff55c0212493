import math

from pyspark.sql import functions as F

from curbmeter.operators import clean, profile
from curbmeter.schema import PAYMENT, STORE_FLAG


def test_missing_code_is_kept_and_missing_flag_removed(trips):
    df = trips({PAYMENT: None}, {"RatecodeID": None}, {"VendorID": None}, {STORE_FLAG: None})
    assert clean.keep_valid(df).count() == 3


def test_each_rule_and_the_order_in_which_rows_are_charged(trips):
    df = trips(
        {},
        {"fare_amount": None, "trip_distance": -1.0},
        {"trip_distance": 0.0, "fare_amount": -1.0},
        {"fare_amount": 0.0},
        {"passenger_count": 0.0},
        {"tpep_dropoff_datetime": trips({}).first()["tpep_pickup_datetime"]},
        {PAYMENT: 5, "VendorID": 7},
        {"RatecodeID": 99.0},
        {"VendorID": 6},
        {STORE_FLAG: "X"},
    )
    funnel = {r["reason"][:2]: r["rows"] for r in clean.reject_funnel(df).collect()}
    assert funnel == {f"{i:02d}": 1 for i in range(1, 11)}
    assert sum(funnel.values()) == df.count()
    assert clean.keep_valid(df).count() == funnel["10"]


def test_not_a_number_counts_as_missing(trips):
    df = trips({"fare_amount": math.nan}, {"tip_amount": math.nan}, {"tip_amount": None})
    cleaned = clean.clean(df, drop=[])
    # The first row has no fare; the two others are the same row.
    assert cleaned.count() == 1
    assert cleaned.first()["tip_amount"] is None


def test_sparse_threshold_is_strict(trips):
    df = trips({"airport_fee": None, "extra": None}, {"airport_fee": None, "extra": None},
               {"extra": None}, {})
    assert clean.sparse_columns(df) == ["extra"]


def test_sparse_rate_is_measured_without_rows_that_lack_a_key(trips):
    df = trips({"extra": None}, {"fare_amount": None, "extra": None}, {})
    assert clean.sparse_columns(df) == []


def test_padding_is_stripped_before_duplicates_are_found(trips):
    df = trips({STORE_FLAG: " N"}, {STORE_FLAG: "N "}, {STORE_FLAG: "N"}, {STORE_FLAG: "\tY"})
    rows = clean.clean(df, drop=[]).collect()
    assert sorted(r[STORE_FLAG] for r in rows) == ["N", "Y"]


def test_duplicates_that_differ_in_a_dropped_column_merge(trips):
    df = trips({"airport_fee": None}, {"airport_fee": None}, {"airport_fee": 1.0})
    assert clean.clean(df).count() == 1


def test_total_below_fare_is_reported_and_kept(trips):
    df = trips({"total_amount": 1.0}, {"total_amount": 20.0})
    assert clean.fare_consistency(df).first()["total_below_fare"] == 1
    assert clean.keep_valid(df).count() == 2


def test_absent_columns_have_no_rule(trips):
    df = trips({}, {STORE_FLAG: "X"}).drop(STORE_FLAG, PAYMENT, "RatecodeID")
    assert clean.clean(df, drop=[]).count() == 1


def test_stats_add_up(trips):
    df = trips({}, {}, {"fare_amount": None}, {"trip_distance": 0.0}, {PAYMENT: 0})
    row = clean.clean_stats(df, drop=[]).first()
    assert row.asDict() == {
        "rows_before": 5, "rows_after": 1, "removed_missing": 1, "removed_outlier": 1,
        "removed_category": 1, "removed_duplicate": 1,
    }


def test_filters_reach_the_parquet_reader(spark, trips, tmp_path):
    path = str(tmp_path / "trips")
    trips({}, {PAYMENT: 0}).write.parquet(path)
    plan = clean.keep_valid(spark.read.parquet(path)).select("fare_amount")
    text = plan._jdf.queryExecution().executedPlan().toString()
    pushed = plan._sc._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "formatted")
    filters = next(line for line in pushed.splitlines() if "PushedFilters" in line)
    for part in ("GreaterThan(fare_amount,0.0)", "In(payment_type", "IsNotNull(total_amount)"):
        assert part in filters
    assert "airport_fee" not in text


def test_hot_duplicate_is_folded_before_the_shuffle(spark, trips):
    df = trips({}).crossJoin(spark.range(2000)).drop("id")
    assert profile.duplicate_count(df).first()["duplicates"] == 1999
    plan = df.dropDuplicates()._jdf.queryExecution().executedPlan().toString()
    assert plan.index("HashAggregate") < plan.index("Exchange") < plan.rindex("HashAggregate")


def test_whitespace_only_difference_between_reason_and_filter(trips):
    df = trips({STORE_FLAG: "  "}, {STORE_FLAG: "y"})
    assert clean.keep_valid(df).count() == 0
    assert clean.with_reason(df).where(F.col("reason") == clean.KEPT).count() == 0
