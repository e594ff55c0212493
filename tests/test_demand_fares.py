import pytest

from curbmeter.operators import demand, fares
from curbmeter.operators.sampling import fixed_sample, histogram
from tests.conftest import at


def ride(hour, day=1, **change):
    return {
        "tpep_pickup_datetime": at(hour, day),
        "tpep_dropoff_datetime": at(hour, day, 30),
        **change,
    }


def test_hour_grid_is_full_and_zero_filled(trips):
    df = trips(ride(8), ride(8), ride(9, day=6))
    rows = {(r["is_weekend"], r["pickup_hour"]): r["trips"] for r in demand.hourly_by_day_type(df).collect()}
    assert len(rows) == 48 and sum(rows.values()) == 3
    assert rows[False, 8] == 2 and rows[True, 9] == 1 and rows[False, 9] == 0


def test_grid_on_an_empty_selection(trips):
    assert {r["trips"] for r in demand.hourly_by_day_type(trips({}).where("false")).collect()} == {0}


def test_matrix_has_every_weekday_and_counts_present_totals(trips):
    df = trips(ride(0, 1), ride(23, 7), ride(23, 7, total_amount=None))
    rows = demand.weekday_hour_matrix(df).orderBy("pickup_weekday").collect()
    assert [r["pickup_weekday"] for r in rows] == list(range(7))
    assert rows[0]["h00"] == 1 and rows[6]["h23"] == 1
    assert sum(sum(r[f"h{h:02d}"] for h in range(24)) for r in rows) == 2


def test_cube_leaves_out_missing_zones_and_summary_matches(trips):
    df = trips(ride(8), ride(8), ride(9), ride(8, PULocationID=None), ride(8, PULocationID=7))
    cube = demand.demand_cube(df)
    assert {(r[0], r[1], r[2], r[3]) for r in cube.collect()} == {
        (100, 8, 0, 2), (100, 9, 0, 1), (7, 8, 0, 1)
    }
    row = demand.demand_summary(cube).first()
    assert (row["cells"], row["zones"], row["min_demand"], row["max_demand"]) == (3, 2, 1, 2)
    assert row["mean_demand"] == 1.33


def test_ties_in_a_ranking_go_to_the_smaller_zone(trips):
    df = trips(*[{"PULocationID": z} for z in (9, 3, 5, 5, 3, 9, 1)])
    rows = demand.top_groups(df, "PULocationID", top=2).collect()
    assert [(r[0], r[1]) for r in rows] == [(3, 2), (5, 2)]


def test_profile_of_busiest_zones(trips):
    df = trips(*[ride(h, PULocationID=z) for z, h in ((1, 0), (1, 1), (2, 5), (3, 6), (2, 5))])
    rows = {(r[0], r[1]): r[2] for r in demand.top_zone_hours(df, top=2).collect()}
    assert len(rows) == 48 and {z for z, _ in rows} == {1, 2} and rows[2, 5] == 2


def test_distinct_values_and_counts(trips):
    df = trips(*[{"PULocationID": z} for z in (9, 3, None, 9, 1)])
    assert [r[0] for r in demand.distinct_values(df, "PULocationID", 2).collect()] == [1, 3]
    assert demand.distinct_count(df, "PULocationID").first()[0] == 3
    assert demand.distinct_count(df, "PULocationID", exact=False).first()[0] == 3


def test_flow_label(trips):
    row = demand.flows(trips({}, {}, {"PULocationID": 1})).first()
    assert row["label"] == "区域100 → 区域200" and row["trips"] == 2


def test_hour_without_trips_has_no_mean(trips):
    rows = demand.hourly_fare_by_day_type(trips(ride(8), ride(8, fare_amount=20.0))).collect()
    means = {(r["is_weekend"], r["pickup_hour"]): r["avg_fare"] for r in rows}
    assert len(means) == 48 and means[False, 8] == 15.0 and means[True, 8] is None


def test_zero_fare_has_no_tip_rate(trips):
    df = trips({"fare_amount": 0.0, "tip_amount": 1.0}, {}, {"tip_amount": 30.0})
    assert [r["tip_rate"] for r in fares.with_tip_rate(df).collect()] == [20.0]


def test_box_plot_numbers(trips):
    prices = [1.0, 2.0, 3.0, 4.0, 40.0]
    df = trips(*[{"fare_amount": p} for p in prices], *[{"fare_amount": 500.0, "passenger_count": 2.0}])
    row = fares.fare_by_passengers(df).collect()
    assert len(row) == 1
    row = row[0]
    assert (row["q1"], row["median"], row["q3"]) == (2.0, 3.0, 4.0)
    assert (row["whisker_low"], row["whisker_high"], row["fliers"]) == (1.0, 4.0, 1)
    assert row["avg_fare"] == 10.0 and row["trips"] == 5


def test_payment_share_counts_missing_types_in_the_whole(trips):
    df = trips({}, {"payment_type": 2}, {"payment_type": 8}, {"payment_type": None})
    rows = {r["payment_type"]: r for r in fares.payment_share(df).collect()}
    assert set(rows) == {1, 2, 8}
    assert rows[1]["share_pct"] == 25.0 and rows[1]["name"] == "信用卡" and rows[8]["name"] == "类型8"


def test_other_fees_come_from_rounded_means(trips):
    df = trips({"fare_amount": 1.004, "tip_amount": 0.0, "total_amount": 2.006})
    row = fares.fee_structure(df).first()
    assert (row["fare_amount"], row["total_amount"], row["other_fees"]) == (1.0, 2.01, 1.01)


def test_empty_hour_has_share_zero(trips):
    rows = {r["pickup_hour"]: r for r in fares.hourly_payment_share(trips(ride(8), ride(8, payment_type=2))).collect()}
    assert len(rows) == 24
    assert rows[8]["type_1_pct"] == 50.0 and rows[9]["type_1_pct"] == 0.0 and rows[9]["trips"] == 0


def test_sample_has_its_size_and_is_repeatable(spark):
    df = spark.range(5000).selectExpr("id", "id % 7 as g")
    one = sorted(r["id"] for r in fixed_sample(df, 300).collect())
    two = sorted(r["id"] for r in fixed_sample(df.repartition(7), 300).collect())
    assert len(one) == 300 == len(set(one)) and one == two
    assert 1500 < sum(one) / 300 < 3500
    assert fixed_sample(df, 9000).count() == 5000


def test_sample_of_many_copies(spark):
    df = spark.range(4000).selectExpr("if(id % 3 = 0, 0, id) as v")
    assert fixed_sample(df, 1000).count() == 1000
    hot = spark.range(4000).selectExpr("0 as v")
    assert fixed_sample(hot, 1000).count() == 1000


def test_histogram_closes_its_last_bin(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "v double")
    rows = histogram(df, "v", 2).orderBy("bin").collect()
    assert [r["n"] for r in rows] == [1, 2]
    assert sum(r["density"] * 0.5 for r in rows) == pytest.approx(1.0)


def test_histogram_of_equal_values(spark):
    rows = histogram(spark.createDataFrame([(3.0,), (3.0,)], "v double"), "v", 4).orderBy("bin").collect()
    assert [r["n"] for r in rows] == [0, 0, 2, 0]
    assert (rows[0]["bin_start"], rows[3]["bin_end"]) == (2.5, 3.5)
