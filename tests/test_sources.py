import math

import pytest
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from curbmeter.functions.timing import with_duration, with_time_features
from curbmeter.operators import profile
from curbmeter.operators.clean import keep_valid
from curbmeter.plans.batch import run_batch
from curbmeter.schema import TRIP_SCHEMA
from curbmeter.sources.tables import (
    conform,
    preview,
    read_trips,
    read_zones,
    with_zone_names,
    write_trips,
)
from curbmeter.streaming.trips import read_trip_stream, valid_trips_with_features
from tests.conftest import at
from tests.test_demand_fares import ride


def test_parquet_round_trip(spark, trips, tmp_path):
    path = str(tmp_path / "t")
    df = trips({}, {"fare_amount": None})
    write_trips(df, path)
    back = read_trips(spark, path)
    assert back.schema == df.schema and back.exceptAll(df).count() == 0 == df.exceptAll(back).count()


def test_partitioned_write_keeps_every_row(spark, trips, tmp_path):
    path = str(tmp_path / "t")
    df = with_time_features(trips(ride(1), ride(2), ride(3, day=2))).drop("pickup_datetime")
    write_trips(df, path, partition_by="pickup_date")
    assert read_trips(spark, path).count() == 3
    assert sorted(p.name for p in (tmp_path / "t").glob("pickup_date=*")) == [
        "pickup_date=2024-01-01", "pickup_date=2024-01-02",
    ]


def test_csv_has_a_header(trips, tmp_path):
    write_trips(trips({}), str(tmp_path / "c"), format="csv")
    text = next((tmp_path / "c").glob("*.csv")).read_text()
    assert text.startswith("VendorID,tpep_pickup_datetime")


def test_missing_path_raises(spark, tmp_path):
    with pytest.raises(AnalysisException):
        read_trips(spark, str(tmp_path / "nothing"))


def test_types_are_cast_and_other_columns_kept(spark):
    df = spark.sql("select 1L as VendorID, 2 as passenger_count, timestamp'2024-01-01 05:00:00' as tpep_pickup_datetime, 'x' as note")
    types = dict(conform(df).dtypes)
    assert types == {
        "VendorID": "bigint", "passenger_count": "double",
        "tpep_pickup_datetime": "timestamp_ntz", "note": "string",
    }


def test_preview(trips):
    df = trips(*[ride(h) for h in (5, 1, 3)])
    hours = lambda frame: [r["tpep_pickup_datetime"].hour for r in frame.collect()]
    assert hours(preview(df, 2)) == [1, 3] and hours(preview(df, 2, last=True)) == [5, 3]


def test_zones(spark, trips, tmp_path):
    path = tmp_path / "zones.csv"
    path.write_text('"LocationID","Borough","Zone","service_zone"\n100,"North","Park, East","Boro"\n7,"South","N/A","N/A"\n')
    zones = read_zones(spark, str(path))
    assert {r["Zone"] for r in zones.collect()} == {"Park, East", "N/A"}
    named = with_zone_names(trips({}, {"PULocationID": 5}), zones).collect()
    assert sorted(str(r["Borough"]) for r in named) == ["None", "North"]


def test_time_features(trips):
    row = with_duration(with_time_features(trips(
        {"tpep_pickup_datetime": at(18, 7), "tpep_dropoff_datetime": at(18, 7).replace(minute=5, second=30)}
    ))).first()
    assert (row["pickup_hour"], row["pickup_weekday"], row["pickup_day"]) == (18, 6, 7)
    assert row["is_weekend"] and row["is_rush_hour"]
    assert row["hour_sin"] == pytest.approx(-1.0) and row["weekday_cos"] == pytest.approx(math.cos(12 * math.pi / 7))
    assert row["duration_min"] == 5.5


def test_features_ignore_the_session_time_zone(spark, trips):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert with_time_features(trips(ride(2))).first()["pickup_hour"] == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_batch_run(spark, trips, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    trips({}, {}, {"payment_type": 5}, {"airport_fee": None, "trip_distance": 5.0}).write.parquet(source)
    result = run_batch(spark, source, target)
    assert result.cleaned.count() == 2
    assert result.reports["quality"].count() == 8
    for name, report in result.reports.items():
        assert report.columns and report.count() >= 0, name
    raw = read_trips(spark, source)
    single = {
        "schema": profile.schema_profile, "domains": profile.domain_summary, "domain_values": profile.domain_values,
        "domain_anomalies": profile.domain_anomalies, "anomaly_total": profile.domain_anomaly_total,
        "null_columns": profile.null_column_count,
    }
    for name, operator in single.items():
        assert sorted(result.reports[name].collect()) == sorted(operator(raw).collect()), name
        assert "Scan parquet" not in result.reports[name]._jdf.queryExecution().executedPlan().toString(), name


def test_batch_run_to_csv(spark, trips, tmp_path):
    source = str(tmp_path / "in")
    trips({}, {"fare_amount": 3.5}).write.parquet(source)
    cleaned = run_batch(spark, source, str(tmp_path / "out"), format="csv").cleaned
    assert sorted(r["fare_amount"] for r in cleaned.collect()) == [3.5, 10.0]
    assert dict(cleaned.dtypes)["tpep_pickup_datetime"] == "timestamp_ntz"


def test_stream_gives_what_the_batch_gives(spark, trips, tmp_path):
    folder = str(tmp_path / "arriving")
    df = trips({}, {"payment_type": 5}, {"store_and_fwd_flag": " Y"}, {"fare_amount": -1.0}, ride(23, 6))
    df.repartition(3).write.parquet(folder)
    stream = valid_trips_with_features(read_trip_stream(spark, folder, TRIP_SCHEMA, files_per_trigger=1))
    query = stream.writeStream.format("memory").queryName("valid_trips").outputMode("append").start()
    try:
        query.processAllAvailable()
        got = spark.table("valid_trips")
        want = with_time_features(keep_valid(df))
        assert got.count() == want.count() == 3
        assert got.exceptAll(want).count() == 0
    finally:
        query.stop()


def test_filters_on_wide_ids_reach_the_reader(spark, trips, tmp_path):
    wide = trips({}, {"PULocationID": 1}).withColumn("PULocationID", F.col("PULocationID").cast("long"))
    wide.write.parquet(str(tmp_path / "wide"))
    df = read_trips(spark, str(tmp_path / "wide")).where("PULocationID = 100")
    assert "EqualTo(PULocationID,100)" in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 1
