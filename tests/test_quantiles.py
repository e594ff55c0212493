import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from curbmeter.operators import buckets
from curbmeter.operators.buckets import Distribution
from curbmeter.operators.quantiles import exact_quantiles, quantile_limits, quantiles

PROBABILITIES = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)


def found(df, by=(), **options):
    return {
        (*[r[k] for k in by], r["column"], r["p"]): r["value"]
        for r in exact_quantiles(df, ["v"], PROBABILITIES, by, **options).collect()
    }


def check(numbers, got, key=()):
    want = np.quantile(np.array(numbers, dtype=float), PROBABILITIES)
    for p, w in zip(PROBABILITIES, want):
        assert got[(*key, "v", p)] == pytest.approx(w, rel=1e-9, abs=1e-300)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.one_of(
            st.floats(-1e9, 1e9, allow_nan=False),
            st.integers(-3, 3).map(float),
            st.floats(1e9, 1e9 + 1),
            st.sampled_from([0.0, -0.0, 1e-300, -1e-300, 1e300]),
        ),
        min_size=1,
        max_size=60,
    ),
    st.booleans(),
)
def test_same_as_numpy(spark, numbers, grouped):
    df = spark.createDataFrame([(1, n) for n in numbers], "g int, v double")
    check(numbers, found(df, ["g"]) if grouped else found(df), (1,) if grouped else ())


@pytest.mark.parametrize("few", [True, False])
def test_one_group_with_most_rows_and_one_hot_value(spark, few):
    df = spark.range(20000).selectExpr(
        "if(id % 3 = 0, 1, cast(id % 50 as int) + 2) as g",
        "if(id % 2 = 0, 7D, cast(id * 37 % 1009 as double) / 8) as v",
    )
    rows = {}
    for r in df.collect():
        rows.setdefault(r["g"], []).append(r["v"])
    got = found(df, ["g"], few_groups=few)
    for g, numbers in rows.items():
        check(numbers, got, (g,))


def test_values_in_one_narrow_cluster_with_a_far_outlier(spark):
    df = spark.range(5000).selectExpr("if(id = 0, 1e18D, 1e9D + id / 1000D) as v")
    check([r["v"] for r in df.collect()], found(df))


def test_nulls_and_not_a_number_are_left_out(spark):
    df = spark.createDataFrame([(1.0,), (None,), (math.nan,), (3.0,)], "v double")
    assert found(df)["v", 0.5] == 2.0


def test_infinities(spark):
    df = spark.createDataFrame([(-math.inf,), (1.0,), (math.inf,)], "v double")
    got = found(df)
    assert (got["v", 0.0], got["v", 0.5], got["v", 1.0]) == (-math.inf, 1.0, math.inf)


def test_empty_column_has_no_limit(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert quantile_limits(df, ["v"], 0.99) == {"v": None}


def test_approximate_form_has_the_same_columns(spark):
    df = spark.range(1000).selectExpr("cast(id as double) as v", "id % 2 as g")
    exact = quantiles(df, ["v"], [0.5], ["g"])
    rough = quantiles(df, ["v"], [0.5], ["g"], exact=False)
    assert exact.columns == rough.columns
    gaps = {r["g"]: r["value"] for r in exact.collect()}
    for r in rough.collect():
        assert abs(r["value"] - gaps[r["g"]]) <= 2


def plan_of(df):
    execution = df._jdf.queryExecution()
    return df.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(execution, "formatted")


def test_the_second_scan_gets_the_ends_of_the_wanted_buckets(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "values")
    spark.range(5000).selectExpr("id * 3 as a", "id / 7D as b", "cast(id / 9 as decimal(12, 4)) as c").write.parquet(path)
    df = spark.read.parquet(path)
    state = Distribution(df, ["a", "b"])
    for column in "ab":
        state.want_quantile([(column,)], 0.5)
    plans, cut = [], buckets.cut_lineage
    monkeypatch.setattr(buckets, "cut_lineage", lambda d: plans.append(plan_of(d)) or cut(d))
    state.read()
    assert len(plans) == 1 and "GreaterThanOrEqual(a,7" in plans[0] and "LessThanOrEqual(b,3" in plans[0]
    found = exact_quantiles(df, ["a", "b", "c"], [0.5])
    rows = df.collect()
    for r in found.collect():
        assert r["value"] == pytest.approx(np.median([float(x[r["column"]]) for x in rows]), rel=1e-12)


def test_buckets_of_one_value_need_no_second_scan(spark, tmp_path):
    path = str(tmp_path / "codes")
    spark.range(1000).selectExpr("cast(id % 5 as int) as v").write.parquet(path)
    df = spark.read.parquet(path)
    got = exact_quantiles(df, ["v"], [0.25, 0.5])
    assert "Scan parquet" not in plan_of(got)
    assert {r["p"]: r["value"] for r in got.collect()} == {0.25: 1.0, 0.5: 2.0}


def test_numbers_beyond_the_doubles_whole_ones(spark):
    big = [2**53 + i for i in range(1, 60)] + [2**62 + 1]
    df = spark.createDataFrame([(n,) for n in big], "v long")
    check([float(n) for n in big], found(df))


@pytest.mark.parametrize("few", [True, False])
@pytest.mark.parametrize("exact", [True, False])
def test_a_null_is_no_group(spark, few, exact):
    df = spark.createDataFrame([(None, 1.0), (1, 2.0), (1, 2.0)], "g int, v double")
    assert [r["g"] for r in quantiles(df, ["v"], [0.5], ["g"], few, exact).collect()] == [1]


@pytest.mark.parametrize("by", [(), ("g",)])
def test_empty_tables_have_no_quantiles(spark, by):
    df = spark.createDataFrame([], "g int, v double")
    assert exact_quantiles(df, ["v"], [0.5], by, few_groups=True).collect() == []


def test_rows_are_counted_before_they_are_shuffled(spark):
    df = spark.range(10).selectExpr("cast(id as double) as v", "id as g")
    plan = exact_quantiles(df, ["v"], [0.5], ["g"])
    lines = plan._jdf.queryExecution().executedPlan().toString().splitlines()
    assert not any("percentile" in line for line in lines)
    # Going up from each scan, an aggregation comes before the first exchange.
    for i in (i for i, line in enumerate(lines) if "Range (0, 10" in line):
        above = [line for line in reversed(lines[:i]) if "Exchange hash" in line or "Aggregate" in line]
        assert "HashAggregate" in above[0] and "partial_count" in above[0]
