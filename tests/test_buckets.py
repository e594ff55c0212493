"""The bucket state against numpy: moments, merged parts, ranges, box plots under a cut, and its two scans."""

import math
import random

import numpy as np
import pytest

from curbmeter.operators import buckets, fares, profile
from curbmeter.operators.buckets import OPEN, Distribution, Buckets, merged, moments


def values(seed, n=700):
    r = random.Random(seed)
    kinds = [lambda: r.gauss(40, 15), lambda: float(r.randrange(-3, 60)), lambda: r.lognormvariate(0, 9), lambda: 12.5, lambda: -0.0]
    return [r.choice(kinds)() for _ in range(n)]


def test_merged_states_are_the_state_of_all_rows(spark):
    numbers = values(1)
    df = spark.createDataFrame([(i % 3, v) for i, v in enumerate(numbers)], "g int, v double")
    parts = Distribution(df, ["v"], ["g"])
    whole = Distribution(df, ["v"]).parts[("v",)]
    several = merged([parts.parts[k] for k in parts.groups("v")])
    for field in ("id", "n", "lo", "hi"):
        assert np.array_equal(getattr(whole, field), getattr(several, field))
    want = (len(numbers), np.mean(numbers), np.std(numbers, ddof=1), min(numbers), max(numbers))
    for state in (whole, several):
        assert moments(state) == pytest.approx(want, rel=1e-9)
    assert merged([]).count == 0 and moments(merged([])) == (0, None, None, None, None)


def test_deviation_of_large_close_values(spark):
    numbers = [1e9 + i / 8 for i in range(50)]
    state = Distribution(spark.createDataFrame([(v,) for v in numbers], "v double"), ["v"]).parts[("v",)]
    assert moments(state)[2] == pytest.approx(np.std(numbers, ddof=1), rel=1e-7)
    one = Distribution(spark.createDataFrame([(3.0,)], "v double"), ["v"]).parts[("v",)]
    assert moments(one) == (1, 3.0, None, 3.0, 3.0)


@pytest.mark.parametrize("seed", [2, 3])
def test_ranges(spark, seed):
    numbers = values(seed)
    known = Distribution(spark.createDataFrame([(v,) for v in numbers], "v double"), ["v"])
    r = random.Random(seed)
    ends = [tuple(sorted((r.choice(numbers) + r.choice([0, 0.01]), r.choice(numbers)))) for _ in range(12)] + [(-OPEN, 12.5), (12.5, 12.5)]
    for low, high in ends:
        known.want_range([("v",)], low, low)
        known.want_range([("v",)], high, high)
    known.read()
    for (low, high), (n, total, least, most) in zip(ends, known.within([([("v",)], *e) for e in ends])):
        inside = [v for v in numbers if low <= v <= high]
        assert n == len(inside) and total == pytest.approx(sum(inside), rel=1e-9, abs=1e-6)
        assert (least, most) == ((min(inside), max(inside)) if inside else (math.inf, -math.inf))


@pytest.mark.parametrize("seed", range(4))
def test_boxes_under_a_cut(spark, seed):
    r = random.Random(seed)
    fare = {0: lambda: round(r.gauss(20, 8), 2), 1: lambda: r.expovariate(0.05), 2: lambda: float(r.randrange(4)), 3: lambda: 7.0}[seed]
    rows = [(r.choice([1.0, 1.0, 2.0, 3.0, 6.0, 9.0, None]), r.choice([fare(), fare(), fare() * 9, None, math.nan])) for _ in range(500)] + [(4.0, 1e9)]
    got = {x["passenger_count"]: x for x in fares.fare_by_passengers(spark.createDataFrame(rows, "passenger_count double, fare_amount double")).collect()}
    known = [f for _, f in rows if f is not None and not math.isnan(f)]
    limit = np.quantile(known, 0.99)
    groups = {}
    for p, f in rows:
        if p in (1, 2, 3, 4, 5, 6) and f is not None and f <= limit:
            groups.setdefault(p, []).append(f)
    assert set(got) == set(groups)
    for p, fs in groups.items():
        q1, median, q3 = np.quantile(fs, (0.25, 0.5, 0.75))
        inside = [f for f in fs if q1 - 1.5 * (q3 - q1) <= f <= q3 + 1.5 * (q3 - q1)]
        want = (len(fs), np.mean(fs), q1, median, q3, min(inside), max(inside), len(fs) - len(inside))
        assert tuple(got[p])[1:] == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_boxes_of_an_empty_table(spark):
    df = spark.createDataFrame([], "passenger_count int, fare_amount double")
    found = fares.fare_by_passengers(df)
    assert found.count() == 0 and found.schema["passenger_count"].dataType.simpleString() == "int"


def test_outliers_against_numpy(spark):
    numbers = values(7)
    df = spark.createDataFrame([(v,) for v in numbers] + [(None,)] * 5, "v double")
    row = profile.iqr_audit(df, ["v"]).first()
    q1, q3 = np.quantile(numbers, (0.25, 0.75))
    beyond = [v for v in numbers if v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1)]
    assert (row["q1"], row["q3"], row["outliers"]) == pytest.approx((q1, q3, len(beyond)))
    assert row["rate_pct"] == pytest.approx(len(beyond) / (len(numbers) + 5) * 100, abs=0.006)
    empty = profile.iqr_audit(df.limit(0), ["v"]).first()
    assert (empty["q1"], empty["outliers"], empty["rate_pct"]) == (None, 0, None)


@pytest.mark.parametrize("report", ["describe", "iqr", "boxes", "tips"])
def test_two_scans_of_the_values(spark, tmp_path, monkeypatch, report):
    path = str(tmp_path / "trips")
    spark.range(3000).selectExpr(
        "cast(id % 7 as double) AS passenger_count", "cast(id % 3 as int) AS payment_type", "id / 7D AS fare_amount", "id / 900D AS tip_amount"
    ).write.parquet(path)
    scans = []
    state, cut = buckets.bucket_state, buckets.cut_lineage

    def count(df, then, *args):
        scans.append(df._jdf.queryExecution().executedPlan().toString().count("FileScan"))
        return then(df, *args)

    monkeypatch.setattr(buckets, "bucket_state", lambda df, keys: count(df, state, keys))
    monkeypatch.setattr(buckets, "cut_lineage", lambda df: count(df, cut))
    df = spark.read.parquet(path)
    report = {
        "describe": lambda: profile.describe(df, ["fare_amount", "tip_amount"]),
        "iqr": lambda: profile.iqr_audit(df, ["fare_amount", "tip_amount"]),
        "boxes": lambda: fares.fare_by_passengers(df),
        "tips": lambda: fares.tip_rates(df),
    }[report]
    found = report()
    assert scans == [1, 1] and "FileScan" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() > 0


def test_a_hand_made_state():
    part = Buckets(*[np.array(x, float) for x in ([1, 2], [2, 2], [1.5, 4], [0.5, 2], [1, 3], [2, 5])])
    assert moments(part) == pytest.approx((4, 2.75, np.std([1, 2, 3, 5], ddof=1), 1, 5))
