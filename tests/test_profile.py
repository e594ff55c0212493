import math

import pytest

from curbmeter.operators import profile
from curbmeter.schema import STORE_FLAG


def values(spark, *numbers):
    return spark.createDataFrame([(n,) for n in numbers], "v double")


def test_iqr_bounds_and_count(spark):
    row = profile.iqr_audit(values(spark, 1.0, 2.0, 3.0, 10.0, None), ["v"]).first()
    assert (row.q1, row.q3, row.lower, row.upper) == (1.75, 4.75, -2.75, 9.25)
    assert (row.outliers, row.rate_pct) == (1, 20.0)


def test_iqr_leaves_out_not_a_number(spark):
    row = profile.iqr_audit(values(spark, 1.0, 2.0, 3.0, 4.0, math.nan), ["v"]).first()
    assert (row.outliers, row.q1) == (0, 1.75)


def test_describe(spark):
    row = profile.describe(values(spark, 1.0, 2.0, 3.0, 4.0, None)).first()
    assert (row["count"], row["mean"], row["min"], row["max"]) == (4, 2.5, 1.0, 4.0)
    assert (row["q25"], row["q50"], row["q75"]) == (1.75, 2.5, 3.25)
    assert row["std"] == pytest.approx(1.2909944487)


def test_describe_of_an_empty_column(spark):
    row = profile.describe(values(spark, None, None)).first()
    assert (row["count"], row["mean"], row["q50"]) == (0, None, None)


def test_null_profile_merges_null_and_not_a_number(spark):
    df = spark.createDataFrame(
        [(math.nan, "a"), (None, None), (1.0, "b"), (2.0, "c")], "x double, y string"
    )
    rows = [tuple(r) for r in profile.null_profile(df).collect()]
    assert rows == [("x", 2, 50.0), ("y", 1, 25.0)]
    assert profile.null_column_count(df).first()[0] == 2
    assert [r[0] for r in profile.worst_null_columns(df, 1).collect()] == ["x"]


def test_rates_are_rounded_half_even(spark):
    # 1 of 800 is 0.125 percent.
    df = spark.range(800).selectExpr("if(id = 0, -1D, 1D) as v")
    assert profile.sign_audit(df, ["v"]).first()["negative_pct"] == 0.12


def test_domain_values_and_anomalies(trips):
    df = trips(
        {"payment_type": 1}, {"payment_type": 5}, {"payment_type": 9}, {"payment_type": None},
        {STORE_FLAG: " Y"}, {STORE_FLAG: "Q"}, {"RatecodeID": 99.0}, {"VendorID": 6},
    )
    found = {(r["column"], r["value"]): r for r in profile.domain_values(df).collect()}
    assert found["payment_type", "5"]["meaning"] == "未知(异常)"
    assert found["payment_type", "9"]["meaning"] == "未知异常值"
    assert not found["payment_type", "9"]["is_standard"]
    # The padded flag is in the domain, but its raw value has no meaning of its own.
    assert found[STORE_FLAG, " Y"]["is_standard"] and found[STORE_FLAG, " Y"]["meaning"] == ""
    assert found["RatecodeID", "99"]["rows"] == 1
    bad = {r["column"]: r["anomalous"] for r in profile.domain_anomalies(df).collect()}
    assert bad == {"payment_type": 2, STORE_FLAG: 1, "RatecodeID": 1, "VendorID": 1}
    assert profile.domain_anomaly_total(df).first()[0] == 5
    summary = {r["column"]: r for r in profile.domain_summary(df).collect()}
    assert summary["payment_type"]["nulls"] == 1
    assert summary["payment_type"]["distinct_values"] == 3


def test_padding(trips):
    df = trips({STORE_FLAG: " Y"}, {STORE_FLAG: "N "}, {STORE_FLAG: None}, {STORE_FLAG: " N "})
    assert tuple(profile.padding_audit(df).first()) == (2, 2)


def test_duplicates_treat_missing_as_equal(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 1.0), (math.nan, 1.0), (1.0, 1.0)], "a double, b double")
    assert profile.duplicate_count(df).first()["duplicates"] == 2


def test_schema_profile(trips):
    rows = {r["column"]: r for r in profile.schema_profile(trips({}, {})).collect()}
    assert rows["fare_amount"]["kind"] == "numeric" and rows[STORE_FLAG]["kind"] == "text"
    assert rows["tpep_pickup_datetime"]["kind"] == "datetime"
    assert {r["rows"] for r in rows.values()} == {2}


def test_quality_report(trips):
    df = trips({}, {}, {"fare_amount": None}, {"trip_distance": 0.0})
    report = {r["metric"][:2]: r["value"] for r in profile.quality_report(df).collect()}
    assert report == {
        "01": 4.0, "02": 19.0, "03": 1.0, "04": 1.0, "05": 1.0, "06": 1.0, "07": 1.0, "08": 25.0,
    }


def test_one_audit_is_one_scan(spark, trips, tmp_path):
    path = str(tmp_path / "trips")
    trips({}, {}).write.parquet(path)
    df = spark.read.parquet(path)
    for audit in (profile.null_profile, profile.sign_audit, profile.domain_summary):
        plan = audit(df)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1
