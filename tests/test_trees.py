"""The node table gives the predictions and importances of the fitted models."""

import pytest
from pyspark.sql import functions as F

from curbmeter.operators import encoding
from curbmeter.plans import forecasting, trees

KEYS = ["PULocationID", "pickup_hour", "pickup_weekday"]


@pytest.fixture(scope="module")
def cells(spark):
    df = spark.range(900).selectExpr(
        "cast(id % 17 AS int) AS PULocationID", "cast(id % 24 AS int) AS pickup_hour", "cast(id % 7 AS int) AS pickup_weekday", "id * id % 41 AS demand"
    ).dropDuplicates(KEYS)
    return df, encoding.zone_encoder(df)


@pytest.mark.parametrize("kind", ["forest", "boosted", "stump"])
def test_same_predictions_and_importances(spark, cells, kind):
    table = forecasting.training_table(*cells)
    estimator = {
        "forest": forecasting.forest(numTrees=5, maxDepth=6),
        "boosted": forecasting.boosted_trees(maxIter=4, maxDepth=3),
        "stump": forecasting.forest(numTrees=2, maxDepth=1, minInstancesPerNode=10**6),
    }[kind]
    model = estimator.fit(table)
    nodes = trees.node_table(spark, model)
    depth = model.getOrDefault("maxDepth")
    ours = trees.predict_by_nodes(table, nodes, KEYS, depth)
    both = model.transform(table).select(*KEYS, F.col("prediction").alias("model")).join(ours, KEYS, "left")
    wrong = both.where(F.col("prediction").isNull() | (F.abs(F.col("prediction") - F.col("model")) > 1e-9))
    assert both.count() == table.count() and wrong.count() == 0
    if kind != "boosted":
        got = {r["feature"]: r["importance"] for r in trees.importance_by_nodes(nodes).collect()}
        assert [got[f] for f in encoding.FEATURES] == pytest.approx(list(model.featureImportances.toArray()), abs=1e-9)


def test_leaves_hold_all_rows_and_a_missing_feature_has_no_prediction(spark, cells):
    table = forecasting.training_table(*cells)
    nodes = trees.node_table(spark, forecasting.boosted_trees(maxIter=1, maxDepth=3).fit(table))
    leaves = nodes.where("feature IS NULL").agg(F.sum("rows")).first()[0]
    assert leaves == table.count() == nodes.where("node = 0").first()["rows"]
    missing = table.withColumns({c: F.lit(None).cast("double") for c in encoding.FEATURES}).limit(3)
    assert {r["prediction"] for r in trees.predict_by_nodes(missing, nodes, KEYS, 3).collect()} == {None}
