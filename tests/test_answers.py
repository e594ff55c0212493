"""Many questions at once give what each gives alone, from one scan of the trips."""

import pytest

from curbmeter.operators.ranks import with_rank
from curbmeter.plans import answers
from curbmeter.plans.answers import answer, answer_all, demand_facts
from tests.conftest import at
from tests.test_demand_fares import ride

ASKED = [
    "平日区域100每小时的订单",
    "区域100 周末 每小时",
    "每小时的订单",
    "休息日每小时的订单",
    "区域5 每小时",
    "区域0 每小时",
    "区域100 哪里最忙",
    "哪里最忙",
    "区域55 哪里最忙",
    "热门上客点 TOP 1",
    "热门下车点 TOP 20",
    "热门上客点 TOP 0",
    "从区域100到区域200要多少钱",
    "从区域100出发要多少钱",
    "去区域9多少钱",
    "多少钱",
    "从区域1到区域2多少钱",
    "付款用现金的多吗",
]


@pytest.fixture(scope="module")
def week(trips):
    return trips(
        ride(8), ride(8), ride(9, day=6), ride(17, PULocationID=7, DOLocationID=9), ride(17, PULocationID=0),
        ride(3, payment_type=2), ride(4, payment_type=None, DOLocationID=9),
        {"tpep_dropoff_datetime": at(8, 1, 5), "trip_distance": 3.0, "tip_amount": 4.5},
    ).cache()


def by_text(spark, week, texts, **options):
    rows = answer_all(week, spark.createDataFrame([(t,) for t in texts], "text string"), **options).collect()
    return [(r["text"], r) for r in rows]


@pytest.mark.parametrize("text", ASKED)
def test_same_as_one_question(spark, week, text):
    (_, got), = by_text(spark, week, [text])
    kinds = {"hourly", "peaks", "ranking", "route", "payment", "forecast", "problem"}
    alone = answer(week, text).collect()
    set_ = {k for k in kinds if got[k] is not None}
    if got["intent"] == "hourly_demand":
        assert set_ == {"hourly"} and got["hourly"].asDict() == alone[0].asDict()
    elif got["intent"] == "peak_hours":
        want = {(r["is_weekend"], r["pickup_hour"]): r["trips"] for r in alone}
        assert set_ == {"peaks"}
        assert got["peaks"]["workday"] == [want[False, h] for h in range(24)]
        assert got["peaks"]["weekend"] == [want[True, h] for h in range(24)]
    elif got["intent"] == "ranking":
        assert [tuple(p) for p in got["ranking"]["places"]] == [(r["location"], r["trips"]) for r in alone]
        assert set_ == {"ranking"} and all(r["total_locations"] == got["ranking"]["total_locations"] for r in alone)
    elif got["intent"] == "route_info":
        route, want = got["route"].asDict(), alone[0].asDict()
        assert set_ == {"route"}
        assert {k: v if v is None else round(v, 1 if "min" in k else 2) for k, v in route.items()} == {k: want[k] for k in route}
    else:
        want = {r["payment_type"]: r for r in alone}
        assert set_ == {"payment"} and [p["payment"] for p in got["payment"]] == sorted(want)
        for p in got["payment"]:
            one = want[p["payment"]]
            assert (p["name"], p["trips"], round(p["share_pct"], 1)) == (one["name"], one["trips"], one["share_pct"])
            assert round(p["avg_tip"], 2) == one["avg_tip_amount"]


def test_repeats_nulls_and_forecasts_without_a_model(spark, week):
    texts = ["预计区域100周一8点", "预计区域100周一8点", "预计区域1周一8点", "预计区域100", None, "预计"]
    rows = by_text(spark, week, texts)
    assert len(rows) == len(texts)
    past = sorted(((t, r["forecast"] and r["forecast"]["historical_demand"], r["problem"]) for t, r in rows if t), key=str)
    assert past == sorted(
        [("预计区域100周一8点", 3, None)] * 2
        + [("预计区域1周一8点", None, None), ("预计区域100", None, "missing: hour, weekday"),
           ("预计", None, "missing: location, hour, weekday")],
        key=str,
    )
    assert answer_all(week, spark.createDataFrame([], "text string")).count() == 0
    assert answer_all(week.limit(0), spark.createDataFrame([("每小时",)], "text string")).first()["hourly"]["peak_trips"] == 0


def test_forecasts_with_a_model(spark, week):
    from curbmeter.plans.forecasting import forest, train_forecaster

    fitted = train_forecaster(week, forest(numTrees=2, maxDepth=2, minInstancesPerNode=1))
    text = "预计区域100周一8点"
    (_, got), = by_text(spark, week, [text], forecaster=fitted)
    alone = answer(week, text, fitted).first()
    assert got["forecast"]["predicted_demand"] == alone["predicted_demand"] and got["forecast"]["known_zone"]
    assert got["forecast"]["historical_demand"] == alone["historical_demand"] == 3


def test_trips_are_scanned_once(spark, week, tmp_path):
    path = str(tmp_path / "trips")
    week.write.parquet(path)
    stored = spark.read.parquet(path)
    scans = []
    cut = answers.cut_lineage

    def counted(df):
        scans.append(df._jdf.queryExecution().executedPlan().toString().count("FileScan"))
        return cut(df)

    answers.cut_lineage = counted
    try:
        found = answer_all(stored, spark.createDataFrame([(t,) for t in ASKED], "text string"))
        last = found._jdf.queryExecution().executedPlan().toString()
    finally:
        answers.cut_lineage = cut
    assert sum(scans) == 1 and "FileScan" not in last and "Python" not in last
    facts = demand_facts(stored)
    again = answer_all(stored, spark.createDataFrame([("每小时",)], "text string"), facts=facts)
    assert "FileScan" not in again._jdf.queryExecution().executedPlan().toString()


def test_ranks_over_ranges(spark):
    ids = [(1 << 40) * (i * 7919 % 1000) - (1 << 45) for i in range(1000)] + [-(1 << 62), (1 << 62)]
    df = spark.createDataFrame([(i,) for i in ids], "zone long").repartition(5)
    ranked = with_rank(df, "zone", parts=7)
    got = {r["zone"]: r["rank"] for r in ranked.collect()}
    assert got == {z: i for i, z in enumerate(sorted(ids), 1)}
    assert "SinglePartition" not in ranked._jdf.queryExecution().executedPlan().toString()
    assert with_rank(df.limit(0), "zone").count() == 0
