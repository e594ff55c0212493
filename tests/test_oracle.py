"""Every registered query against its SQL, and the counts known for the fixture."""

import pytest

from checks.compare import differences, duckdb_tables
from checks.inputs import cleaned_trips, raw_trips
from checks.oracle import ORACLE
from checks.queries import QUERIES, WITHOUT_SQL


@pytest.fixture(scope="module")
def tables(sf_dir):
    return duckdb_tables(sf_dir)


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES) - WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, sf_dir, tables, name):
    assert differences(QUERIES[name](spark, sf_dir), tables, ORACLE[name]) == ""


def test_fixture_counts(spark, sf_dir):
    if not sf_dir.endswith("sf0.001"):
        pytest.skip("counts are known for sf0.001")
    assert raw_trips(spark, sf_dir).count() == 6060
    assert cleaned_trips(spark, sf_dir).count() == 4707
    funnel = {r["reason"][:2]: r["rows"] for r in QUERIES["reject_funnel"](spark, sf_dir).collect()}
    assert funnel == {
        "01": 152, "02": 110, "03": 69, "04": 183, "05": 120,
        "06": 360, "07": 63, "08": 89, "09": 159, "10": 4755,
    }


def test_entry(spark):
    import __spark_entry__ as module

    assert module.entry(spark).count() > 0
    assert module.queries() and module.oracle_sql()
