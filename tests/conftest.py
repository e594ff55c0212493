import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from curbmeter.schema import TRIP_SCHEMA  # noqa: E402
from curbmeter.session import build_session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

GOOD = {
    "VendorID": 1,
    "tpep_pickup_datetime": dt.datetime(2024, 1, 1, 8, 0, 0),
    "tpep_dropoff_datetime": dt.datetime(2024, 1, 1, 8, 10, 0),
    "passenger_count": 1.0,
    "trip_distance": 2.0,
    "RatecodeID": 1.0,
    "store_and_fwd_flag": "N",
    "PULocationID": 100,
    "DOLocationID": 200,
    "payment_type": 1,
    "fare_amount": 10.0,
    "extra": 0.0,
    "mta_tax": 0.5,
    "tip_amount": 2.0,
    "tolls_amount": 0.0,
    "improvement_surcharge": 0.3,
    "total_amount": 12.8,
    "congestion_surcharge": 0.0,
    "airport_fee": 0.0,
}


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions=4,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def trips(spark):
    """Build trips from a good one and the fields that differ."""

    def build(*changes):
        rows = [tuple({**GOOD, **change}[f.name] for f in TRIP_SCHEMA) for change in changes]
        return spark.createDataFrame(rows, TRIP_SCHEMA)

    return build


@pytest.fixture(scope="session")
def sf_dir():
    return SF


def at(hour, day=1, minute=0):
    """A moment in the week of Monday 1 January 2024."""
    return dt.datetime(2024, 1, day, hour, minute)
