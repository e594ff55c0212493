import pytest

from checks.inputs import cleaned_trips
from curbmeter.operators import encoding, evaluation
from curbmeter.plans import forecasting
from curbmeter.plans.analyses import run_analyses
from curbmeter.plans.answers import answer


@pytest.fixture(scope="module")
def forecaster(spark, sf_dir):
    return forecasting.train_forecaster(
        cleaned_trips(spark, sf_dir), forecasting.forest(numTrees=5, maxDepth=4)
    )


def test_codes_follow_numeric_order_over_blocks(spark):
    zones = [300000, 2, 10, 1, 65536, 10]
    df = spark.createDataFrame([(z,) for z in zones], "PULocationID int")
    codes = {r[0]: r[1] for r in encoding.zone_encoder(df).collect()}
    assert codes == {1: 0, 2: 1, 10: 2, 65536: 3, 300000: 4}


def test_unknown_zone_gets_code_zero_and_a_flag(spark):
    encoder = spark.createDataFrame([(5, 0), (6, 1)], "PULocationID int, location_encoded int")
    df = spark.createDataFrame([(6,), (7,)], "PULocationID int")
    rows = {r[0]: (r["location_encoded"], r["known_zone"]) for r in encoding.encode_zones(df, encoder).collect()}
    assert rows == {6: (1, True), 7: (0, False)}


def test_scaling_uses_the_population_deviation_and_can_be_undone(spark):
    df = spark.createDataFrame([(1.0, 4.0), (3.0, 4.0)], "a double, b double")
    scaled = encoding.standardise(df, ["a", "b"])
    assert [tuple(r) for r in scaled.orderBy("a").collect()] == [(-1.0, 0.0), (1.0, 0.0)]
    back = encoding.unscale(scaled, {"a": "a", "b": "b"}, df)
    assert sorted(tuple(r) for r in back.collect()) == [(1.0, 4.0), (3.0, 4.0)]


def test_split_is_a_partition(forecaster):
    train, test = encoding.split(forecaster.cube)
    sizes = encoding.split_counts(forecaster.cube).first()
    assert (train.count(), test.count()) == (sizes["train"], sizes["test"])
    assert train.count() + test.count() == forecaster.cube.count()
    assert 0.1 < test.count() / forecaster.cube.count() < 0.3
    a, b = encoding.random_split(forecaster.cube)
    assert a.count() + b.count() == forecaster.cube.count()


def test_metrics(spark):
    df = spark.createDataFrame([(1, 2.0), (5, 2.0)], "demand long, prediction double")
    row = evaluation.error_metrics(df).first()
    assert (row["mae"], row["rmse"]) == (2.0, pytest.approx(5**0.5))
    perfect = df.selectExpr("demand", "cast(demand as double) as prediction")
    rows = evaluation.compare_models({"a": df, "b": perfect}).collect()
    assert [r["better"] for r in rows] == ["b", "b"] and rows[0]["difference_pct"] == 100.0
    assert evaluation.stack_errors({"a": df, "b": perfect}).count() == 2
    residuals = evaluation.with_residual(df)
    assert evaluation.residual_summary(residuals).first()["mean_residual"] == 1.0
    assert tuple(evaluation.actual_range(df).first()) == (1, 5)


def test_model_tables_no_longer_depend_on_the_trips(forecaster):
    for table in (forecaster.cube, forecaster.encoder):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "FileScan" not in plan


def test_evaluation_beats_the_overall_mean(spark, sf_dir):
    scored = forecasting.evaluate(
        cleaned_trips(spark, sf_dir),
        {"forest": forecasting.forest(numTrees=5, maxDepth=4), "boost": forecasting.boosted_trees(maxIter=3)},
    )
    actual = scored["forest"].count()
    assert actual > 0 and scored["boost"].count() == actual
    row = evaluation.error_metrics(scored["forest"]).first()
    assert 0 < row["mae"] <= row["rmse"] < 5


def test_importance_sums_to_one_and_is_ascending(spark, forecaster):
    rows = forecasting.feature_importance(forecaster.model, spark).collect()
    weights = [r["importance"] for r in rows]
    assert len(rows) == 7 and weights == sorted(weights) and sum(weights) == pytest.approx(1.0)
    assert {r["label"] for r in rows} >= {"区域编码", "是否周末"}


def test_requests(spark, forecaster):
    cell = forecaster.cube.orderBy("PULocationID", "pickup_hour", "pickup_weekday").first()
    requests = spark.createDataFrame(
        [(cell[0], cell[1], cell[2]), (9999, 8, 6)], "location_id int, hour int, weekday int"
    )
    rows = {r["location_id"]: r for r in forecasting.score_requests(requests, forecaster).collect()}
    known, unknown = rows[cell[0]], rows[9999]
    assert known["historical_demand"] == cell["demand"] and known["known_zone"]
    assert unknown["historical_demand"] is None and not unknown["known_zone"]
    assert unknown["is_weekend"] and unknown["is_rush_hour"] and unknown["weekday_name"] == "周日"
    assert unknown["predicted_demand"] == round(unknown["predicted_demand"], 1)


def test_forecast_by_text(spark, sf_dir, forecaster):
    row = answer(cleaned_trips(spark, sf_dir), "请预估区域100周二 下午3点的订单", forecaster).first()
    assert (row["location_id"], row["hour"], row["weekday"]) == (100, 3, 1)


def test_full_settings_are_the_default():
    forest = forecasting.forest()
    assert (forest.getNumTrees(), forest.getMaxDepth(), forest.getMinInstancesPerNode()) == (100, 15, 5)


def test_training_does_not_depend_on_the_layout_of_its_input(spark, forecaster):
    few = forecasting.forest(numTrees=4, maxDepth=4)
    predictions = []
    for parts in (1, 7):
        cube = forecaster.cube.repartition(parts, "demand")
        table = forecasting.training_table(cube, forecaster.encoder, cells_per_task=500)
        rows = few.fit(table).transform(table).select("PULocationID", "pickup_hour", "pickup_weekday", "prediction")
        predictions.append(sorted(tuple(r) for r in rows.collect()))
    assert predictions[0] == predictions[1]


def test_small_passes_fit_the_same_trees(spark, forecaster):
    assert forecasting.forest().getMaxMemoryInMB() <= 256
    table = forecasting.training_table(forecaster.cube, forecaster.encoder)
    settings = {"numTrees": 4, "maxDepth": 8}
    one, whole = (forecasting.forest(**settings, maxMemoryInMB=mb).fit(table) for mb in (1, 1024))
    assert one.toDebugString.split("\n")[1:] == whole.toDebugString.split("\n")[1:] and one.featureImportances == whole.featureImportances


def test_importance_is_ascending(spark, forecaster):
    rows = forecasting.feature_importance(forecaster.model, spark).collect()
    shares = [r["importance"] for r in rows]
    assert len(rows) == 7 and shares == sorted(shares) and sum(shares) == pytest.approx(1)


def scans(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return plan.count("Scan parquet") + plan.count("Scan ExistingRDD")


def test_the_encoder_reads_its_input_once(spark, trips, tmp_path):
    trips({}, {"PULocationID": 70000}).write.parquet(str(tmp_path / "t"))
    assert scans(encoding.zone_encoder(spark.read.parquet(str(tmp_path / "t")))) == 1


def test_the_analysis_chain_reads_the_trips_twice(spark, trips, tmp_path):
    trips({}, {"PULocationID": 7, "payment_type": None}).write.parquet(str(tmp_path / "t"))
    sets = run_analyses(spark.read.parquet(str(tmp_path / "t")), distributions=False)
    for name, df in sets.items():
        assert "Scan parquet" not in df._jdf.queryExecution().executedPlan().toString(), name
    assert sets["payment_share"].collect()[0]["share_pct"] == 50.0
    assert run_analyses(spark.read.parquet(str(tmp_path / "t"))).keys() - sets.keys() == {
        "distance_fare_clip", "fare_by_passengers", "tip_rate"
    }
    empty = run_analyses(trips({}).limit(0), distributions=False)
    assert empty["hourly_by_daytype"].count() == 48 and empty["od_flows"].count() == 0
