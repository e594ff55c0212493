"""The clustered layout: same rows, few row groups for a route."""

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from checks.inputs import cleaned_trips
from curbmeter.plans import questions
from curbmeter.sources.clustered import curve_key, write_clustered


def groups_with(path, **wanted):
    """How many row groups can hold rows of these values, by their statistics, and how many there are."""
    hit = every = 0
    for file in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        place = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
        for g in range(meta.num_row_groups):
            every += 1
            stats = {c: meta.row_group(g).column(place[c]).statistics for c in wanted}
            hit += all(stats[c].min <= v <= stats[c].max for c, v in wanted.items())
    return hit, every


def test_a_route_reads_few_row_groups(spark, tmp_path):
    trips = cleaned_trips(spark, "/root/testdata/sf0.01")
    path = str(tmp_path / "clustered")
    write_clustered(trips, path, files=96)
    for pair in ((100, 9), (17, 200), (3, 3), (265, 265)):
        hit, every = groups_with(path, PULocationID=pair[0], DOLocationID=pair[1])
        assert every >= 80 and hit < 0.1 * every, (pair, hit, every)
    hit, every = groups_with(path, PULocationID=100)
    assert hit < 0.4 * every
    back = spark.read.parquet(path)
    assert back.exceptAll(trips).count() == trips.exceptAll(back).count() == 0
    for pair in ((100, 9), (100, None)):
        assert questions.route_info(back, *pair).first() == questions.route_info(trips, *pair).first()
    assert sorted(questions.peak_hours(back, 100).collect()) == sorted(questions.peak_hours(trips, 100).collect())


def test_keys_of_odd_rows(spark, trips, tmp_path):
    df = trips({}, {"PULocationID": None, "tpep_pickup_datetime": None}, {"PULocationID": 7})
    keys = [r[0] for r in df.select(curve_key(df)).collect()]
    assert len(keys) == 3 and None not in keys
    path = str(tmp_path / "odd")
    write_clustered(df, path)
    assert spark.read.parquet(path).exceptAll(df).count() == 0
    write_clustered(df.limit(0), path)
    assert spark.read.parquet(path).count() == 0


def test_near_places_are_near_on_the_curve(spark):
    df = spark.range(64).select((F.col("id") % 8).alias("a"), (F.col("id") / 8).cast("int").alias("b"))
    keyed = {(r["a"], r["b"]): r["k"] for r in df.select("a", "b", curve_key(df, ("a", "b"), bits=3).alias("k")).collect()}
    assert sorted(keyed.values()) == list(range(64))
    assert {keyed[a, b] for a in range(4) for b in range(4)} == set(range(16))


def test_layout_keeps_nan_and_double_columns(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2), (float("nan"), 3), (None, 4)], "x double, y int")
    path = str(tmp_path / "nan")
    write_clustered(df, path, ("x", "y"), files=2)
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(Exception):
        write_clustered(df, path, ("none",))
