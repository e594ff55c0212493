import pytest

from curbmeter.plans import questions
from curbmeter.plans.answers import answer
from curbmeter.plans.tagging import tag_text
from curbmeter.schema import WEEKEND, WORKDAY
from tests.conftest import at
from tests.test_demand_fares import ride


def tags(spark, text):
    return tag_text(spark.createDataFrame([(text,)], "text string")).first().asDict()


@pytest.mark.parametrize(
    "text, expected",
    [
        ("从区域100到区域200要多少钱",
         {"intent": "route_info", "route_from": 100, "route_to": 200, "location": 100}),
        ("热门上客点 TOP 5", {"intent": "ranking", "top_n": 5, "rank_type": "上车"}),
        ("下客排行前 3 的地方", {"intent": "ranking", "top_n": 3, "rank_type": "下车"}),
        ("请预估区域100周二 下午3点的订单",
         {"intent": "predict", "location": 100, "weekday": 1, "hour": 3}),
        ("平日每小时的需求量，区域100", {"intent": "predict", "day_type": "工作日"}),
        ("周五哪里最忙", {"intent": "peak_hours", "weekday": 4, "top_n": 10}),
        ("付款用现金的多吗", {"intent": "payment", "location": None}),
        ("  星期日 17:00 去区域 7 多少钱 ", {"intent": "route_info", "weekday": 6, "hour": 17,
                                         "route_to": 7, "location": 7}),
        ("区域１２ 周末", {"intent": "hourly_demand", "location": 12, "day_type": "周末"}),
        ("你好", {"intent": "hourly_demand", "location": None, "day_type": None}),
        ("到达区域5的时间", {"intent": "route_info", "route_to": None, "rank_type": "上车"}),
        ("区域99999999999999999999", {"intent": "hourly_demand", "location": None}),
    ],
)
def test_tags(spark, text, expected):
    got = tags(spark, text)
    assert {k: got[k] for k in expected} == expected


def test_missing_text_has_the_default_intent(spark):
    assert tags(spark, None)["intent"] == "hourly_demand"


def test_tagging_needs_no_shuffle_and_no_python(spark):
    plan = tag_text(spark.createDataFrame([("x",)], "text string").repartition(1))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "Python" not in text


def test_peak_tie_goes_to_the_earlier_hour(trips):
    df = trips(ride(2), ride(3), ride(2), ride(3), ride(7))
    row = questions.hourly_demand_answer(df).first()
    assert (row["peak_hour"], row["peak_trips"], row["avg_demand"]) == (2, 2, 0.2)
    assert (row["morning_peak_hour"], row["morning_peak_trips"]) == (7, 1)
    assert (row["evening_peak_hour"], row["evening_peak_trips"]) == (16, 0)


def test_day_type_and_zone_filters(trips):
    df = trips(ride(8), ride(8, day=6), ride(9, day=7, PULocationID=0))
    total = lambda *a: sum(r["trips"] for r in questions.hourly_demand(df, *a).collect())
    assert (total(), total(None, WORKDAY), total(None, WEEKEND)) == (3, 1, 2)
    # Zone 0 is a zone and not the absence of a filter.
    assert (total(0), total(100), total(5)) == (1, 2, 0)
    assert questions.hourly_demand(df, 5).count() == 24


def test_route_means_and_empty_route(trips):
    df = trips({"tpep_dropoff_datetime": at(8, 1, 5)}, {"trip_distance": 3.0})
    row = questions.route_info(df, 100, 200).first()
    assert (row["trip_count"], row["avg_distance"], row["avg_duration_min"]) == (2, 2.5, 7.5)
    assert row["description"] == "出发区域100、到达区域200"
    empty = questions.route_info(df, 1, None).first()
    assert (empty["trip_count"], empty["avg_fare"], empty["description"]) == (0, None, "出发区域1")
    assert questions.route_info(df).first()["description"] == "全路线"


def test_payment_analysis(trips):
    df = trips({}, {"tip_amount": 3.0}, {"payment_type": 2, "tip_amount": 0.0})
    rows = {r["payment_type"]: r for r in questions.payment_analysis(df).collect()}
    assert rows[1]["card_tip_avg"] == 2.5 and rows[2]["cash_tip_avg"] == 0.0
    assert rows[1]["share_pct"] == 66.7


def test_answers_by_text(trips):
    df = trips(ride(8), ride(9), ride(17, PULocationID=7, DOLocationID=9))
    assert [r["location"] for r in answer(df, "热门上客点 TOP 1").collect()] == [100]
    assert answer(df, "下客点下车排行前5").count() == 2
    assert answer(df, "从区域7到区域9的费用").first()["trip_count"] == 1
    assert answer(df, "区域100 周末 每小时").first()["peak_trips"] == 0
    assert answer(df, "周五哪里最忙").count() == 48
    assert answer(df, "现金和信用卡").count() == 1
    with pytest.raises(ValueError):
        answer(df, "预测区域100的需求")
    with pytest.raises(ValueError):
        answer(df, "预测区域100 周二 3点")
