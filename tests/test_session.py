"""Session settings and the checks before broadcasts and shared folders."""

import pytest

from curbmeter import session


class Cluster:
    master = "spark://host:7077"

    def getCheckpointDir(self):
        return None


class ClusterSession:
    sparkContext = Cluster()

    class conf:
        @staticmethod
        def get(key, default):
            return default


def test_no_local_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_root(ClusterSession())


def test_broadcast_is_bounded_by_rows_and_bytes(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))

    def hinted(df):
        return "broadcast" in df._jdf.queryExecution().logical().toString().lower()

    assert hinted(session.broadcast_if_small(table))
    assert not hinted(session.broadcast_if_small(table, rows=99))
    assert not hinted(session.broadcast_if_small(table, size=10))


def test_route_labels_take_text_zones(spark):
    from curbmeter.functions.values import route_label

    row = spark.createDataFrame([("a", "b")], "x string, y string").select(route_label("x", "y")).first()
    assert row[0] == "区域a → 区域b"


def test_forest_settings_can_be_replaced():
    from curbmeter.plans.forecasting import forest

    assert forest(maxBins=500, featureSubsetStrategy="sqrt").getMaxBins() == 500
