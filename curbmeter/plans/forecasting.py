"""Demand forecasting on Spark ML."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbmeter.operators.demand import demand_cube
from curbmeter.operators.encoding import (
    FEATURES,
    demand_features,
    encode_zones,
    split,
    with_demand_features,
    with_vector,
    zone_encoder,
)
from curbmeter.schema import PICKUP_ZONE, RUSH_HOURS, WEEKDAY_NAMES, WEEKEND_DAYS
from curbmeter.session import broadcast_if_small, cut_lineage

# Cells of a training task: each is worked on in every level of every tree. A level is one job
# over all tasks, so small ones pay for their start more often than for their cells.
CELLS_PER_TASK = 6000
# Memory for the statistics of the nodes of one pass, held by each of its tasks. Deep levels take several passes;
# with 1024 MB they took as much in every task, and spilled. The fitted trees are the same.
NODE_MEMORY_MB = 256
# Forest settings, and the labels of the features in reports.
FOREST = {"numTrees": 100, "maxDepth": 15, "minInstancesPerNode": 5, "seed": 42}
FEATURE_LABELS = {
    "location_encoded": "区域编码",
    "hour_sin": "小时(sin)",
    "hour_cos": "小时(cos)",
    "weekday_sin": "星期(sin)",
    "weekday_cos": "星期(cos)",
    "is_weekend": "是否周末",
    "is_rush_hour": "是否高峰时段",
}


@dataclass
class Forecaster:
    """A fitted model with the tables needed to use it; both tables are checkpointed."""

    model: object
    cube: DataFrame
    encoder: DataFrame


def forest(**settings) -> RandomForestRegressor:
    """The random forest (M5): every split sees all features and up to 300 zones apart.

    Give ``maxBins`` where there are more zones than that.
    """
    options = {"featureSubsetStrategy": "all", "maxBins": 300, "maxMemoryInMB": NODE_MEMORY_MB, **FOREST, **settings}
    return RandomForestRegressor(labelCol="demand", featuresCol="features", **options)


def boosted_trees(**settings) -> GBTRegressor:
    """Boosted trees as the second regressor (M6)."""
    options = {"maxIter": 20, "maxDepth": 5, "maxBins": 300, "seed": 42, **settings}
    return GBTRegressor(labelCol="demand", featuresCol="features", **options)


def demand_tables(trips: DataFrame, zone: str = PICKUP_ZONE) -> tuple:
    """Demand cube and zone codes, checkpointed.

    Training passes over the cube dozens of times. Cutting the lineage means
    that a lost executor costs a read of this small table and never another
    scan of the trips.
    """
    cube = cut_lineage(demand_cube(trips, zone))
    return cube, cut_lineage(zone_encoder(cube, zone))


def training_table(
    cube: DataFrame, encoder: DataFrame, zone: str = PICKUP_ZONE, cells_per_task: int = CELLS_PER_TASK
) -> DataFrame:
    """Features, vector and label of all cells, spread for training.

    The cube is small in bytes, so it arrives in very few partitions, but each
    cell costs much work in every tree. Bagging draws per partition and in the
    order of its rows, so the fitted model must not depend on the cores there
    are: the number of partitions follows from the cells alone, and rows are
    sorted in them.
    """
    parts = cube.count() // cells_per_task + 1
    key = [zone, "pickup_hour", "pickup_weekday"]
    features = with_vector(demand_features(cube, broadcast_if_small(encoder), zone))
    # After the join: Catalyst drops a sort below one.
    return features.repartition(parts, *key).sortWithinPartitions(*key)


def train_forecaster(trips: DataFrame, estimator=None, zone: str = PICKUP_ZONE) -> Forecaster:
    """Fit on all cells, as for answering questions (M5)."""
    cube, encoder = demand_tables(trips, zone)
    model = (estimator or forest()).fit(training_table(cube, encoder, zone))
    return Forecaster(model, cube, encoder)


def evaluate(trips: DataFrame, estimators: dict, zone: str = PICKUP_ZONE) -> dict:
    """Fit each estimator on the train cells and predict the test cells (M5-M7)."""
    cube, encoder = demand_tables(trips, zone)
    train, test = split(training_table(cube, encoder, zone), zone)
    return {name: estimator.fit(train).transform(test) for name, estimator in estimators.items()}


def feature_importance(model, spark, features=FEATURES) -> DataFrame:
    """Importance per feature with its label, least important first."""
    rows = [
        (name, FEATURE_LABELS.get(name, name), float(weight))
        for name, weight in zip(features, model.featureImportances.toArray())
    ]
    return spark.createDataFrame(
        rows, "feature string, label string, importance double"
    ).orderBy("importance", "feature")


def weekday_name(day: Column) -> Column:
    """Name of a Monday = 0 weekday, null outside 0..6."""
    names = F.array(*[F.lit(n) for n in WEEKDAY_NAMES])
    return F.when(day.between(0, 6), F.get(names, day))


def score_requests(
    requests: DataFrame, forecaster: Forecaster, zone: str = PICKUP_ZONE
) -> DataFrame:
    """Predicted and past demand for ``(location_id, hour, weekday)`` rows.

    ``historical_demand`` is the demand of exactly that cell, null without one.
    """
    hour, day = F.col("hour"), F.col("weekday")
    featured = with_demand_features(
        encode_zones(
            requests, broadcast_if_small(forecaster.encoder).withColumnRenamed(zone, "location_id"),
            "location_id",
        ),
        "hour",
        "weekday",
    )
    predicted = forecaster.model.transform(with_vector(featured))
    history = broadcast_if_small(
        forecaster.cube.select(
            F.col(zone).alias("location_id"),
            F.col("pickup_hour").alias("hour"),
            F.col("pickup_weekday").alias("weekday"),
            F.col("demand").alias("historical_demand"),
        )
    )
    return predicted.join(history, ["location_id", "hour", "weekday"], "left").select(
        "location_id",
        "hour",
        "weekday",
        weekday_name(day).alias("weekday_name"),
        F.bround("prediction", 1).alias("predicted_demand"),
        "historical_demand",
        hour.isin(*RUSH_HOURS).alias("is_rush_hour"),
        day.isin(*WEEKEND_DAYS).alias("is_weekend"),
        "known_zone",
    )
