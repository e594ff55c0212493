"""Months with other types and spellings read as one table, with filters in every scan."""

import pytest

from curbmeter.schema import TRIP_SCHEMA
from curbmeter.sources.months import physical_schemas, read_months


@pytest.fixture()
def months(spark, trips, tmp_path):
    base = trips({}, {"PULocationID": 7, "airport_fee": 1.75}, {"PULocationID": 9, "RatecodeID": None})
    parts = {
        "a": base,
        "b": base.selectExpr("* except (PULocationID, RatecodeID, airport_fee)", "cast(PULocationID AS bigint) AS pulocationid",
                             "cast(RatecodeID AS bigint) AS RatecodeID", "airport_fee AS Airport_fee", "'x' AS note"),
        "c": base.drop("airport_fee").selectExpr("*", "5 AS Note"),
        "d": base,
    }
    paths = []
    for name, part in parts.items():
        paths.append(str(tmp_path / name))
        part.coalesce(1).write.parquet(paths[-1])
    return paths


def test_one_table_of_all_months(spark, months):
    df = read_months(spark, months)
    assert df.columns == [*TRIP_SCHEMA.names, "note"] and df.count() == 12
    kinds = dict(df.dtypes)
    assert (kinds["PULocationID"], kinds["RatecodeID"], kinds["airport_fee"], kinds["note"]) == ("bigint", "double", "double", "string")
    rows = df.where("PULocationID = 7").select("airport_fee", "note", "RatecodeID").collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(1.75, None, 1.0), (1.75, "x", 1.0), (None, "5", 1.0), (1.75, None, 1.0)], key=str)


def test_equal_schemas_share_a_scan_and_filters_reach_all(spark, months):
    assert [len(paths) for _, paths in physical_schemas(spark, months).values()] == [2, 1, 1]
    df = read_months(spark, months).where("PULocationID = 7").select("fare_amount", "PULocationID")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 3
    for line in (x for x in plan.splitlines() if "FileScan" in x):
        assert "ulocationid,7)" in line.lower() and "tolls_amount" not in line


def test_one_path_is_read_as_it_is_and_faults_are_told(spark, months, tmp_path):
    same = read_months(spark, months[:1])
    assert dict(same.dtypes)["PULocationID"] == "int"
    with pytest.raises(ValueError):
        read_months(spark, [])
    with pytest.raises(Exception, match="PATH_NOT_FOUND|Path does not exist"):
        read_months(spark, [str(tmp_path / "none")])
