"""Fitted trees as a table, and what can be worked out from it alone.

The nodes of a forest or of boosted trees are rows. A prediction is then an
iterated equi-join - every row stands at one node per tree and moves to a child -
and an importance is a sum over the splits. Both are a second way to the numbers
of the fitted model, and work where the model itself is not at hand.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbmeter.operators.encoding import FEATURES
from curbmeter.session import broadcast_if_small, checkpoint_root


def node_table(spark: SparkSession, model) -> DataFrame:
    """``tree, weight, node, prediction, rows, gain, feature, threshold, left, right`` of a fitted ensemble.

    ``feature`` is the place in the vector; it, the threshold and the children
    are null in a leaf. ``weight`` is what a tree counts in the prediction. Read
    from the model as saved in the shared folder, so no node passes the driver.
    """
    path = f"{checkpoint_root(spark)}/trips-{uuid.uuid4().hex}/model"
    model.write().save(path)
    weights = spark.read.parquet(f"{path}/treesMetadata").select(F.col("_1").alias("treeID"), F.col("_3").alias("weight"))
    node = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    total = F.lit(1.0) if "GBT" in type(model).__name__ else F.lit(1.0 / model.getNumTrees)
    inner = F.col("leftChild") >= 0
    # One row per tree.
    return node.join(F.broadcast(weights), "treeID").select(
        F.col("treeID").alias("tree"),
        (F.col("weight") * total).alias("weight"),
        F.col("id").alias("node"),
        "prediction",
        F.col("rawCount").alias("rows"),
        "gain",
        *[
            F.when(inner, value).alias(name)
            for name, value in (
                ("feature", F.col("split.featureIndex")),
                ("threshold", F.col("split.leftCategoriesOrThreshold")[0]),
                ("left", F.col("leftChild")),
                ("right", F.col("rightChild")),
            )
        ],
    )


def predict_by_nodes(df: DataFrame, nodes: DataFrame, keys: list, depth: int, features=FEATURES) -> DataFrame:
    """``(*keys, prediction)`` for rows told apart by ``keys``, from a node table of trees of at most ``depth`` levels.

    A row goes left where its feature is at most the threshold. Rows with a
    missing feature that a split asks for have no prediction. All splits are on
    numbers; there are no categories.
    """
    values = F.array(*[F.col(c).cast("double") for c in features]).alias("values")
    # An entry per tree.
    ensemble = nodes.agg(F.collect_set(F.struct("tree", "weight"))).scalar()
    at = df.select(*keys, values, F.explode(ensemble).alias("_tree")).select(*keys, "values", "_tree.*", F.lit(0).alias("node"))
    small = broadcast_if_small(nodes.select("tree", "node", "prediction", "feature", "threshold", "left", "right"))
    held = [*keys, "values", "tree", "weight", "node"]
    for _ in range(depth):
        value = F.get("values", F.col("feature"))
        child = F.when(value <= F.col("threshold"), F.col("left")).when(value > F.col("threshold"), F.col("right"))
        moved = F.when(F.col("feature").isNull(), F.col("node")).otherwise(child)
        at = at.join(small, ["tree", "node"], "left").withColumn("node", moved).select(*held)
    parts = at.join(small.select("tree", "node", "prediction"), ["tree", "node"], "left")
    whole = F.when(F.count("prediction") == F.count("*"), F.sum(F.col("weight") * F.col("prediction")))
    return parts.groupBy(*keys).agg(whole.alias("prediction"))


def importance_by_nodes(nodes: DataFrame, features=FEATURES) -> DataFrame:
    """``feature, importance`` of every feature: its share of gain by rows in each tree, averaged over the trees."""
    splits = nodes.where(F.col("feature").isNotNull())
    gains = splits.groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("rows")).alias("gain"))
    wholes = gains.groupBy("tree").agg(F.sum("gain").alias("whole"))
    shares = gains.join(wholes, "tree").where("whole > 0")
    mean = shares.groupBy("feature").agg(F.sum(F.col("gain") / F.col("whole")).alias("share"))
    all_ = mean.agg(F.sum("share")).scalar()
    names = nodes.sparkSession.createDataFrame(list(enumerate(features)), "feature int, name string")
    # One row per feature.
    return F.broadcast(names).join(mean, "feature", "left").select(
        F.col("name").alias("feature"), F.coalesce(F.try_divide("share", all_), F.lit(0.0)).alias("importance")
    )
