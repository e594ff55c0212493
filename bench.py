"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the cores, ``BENCH_QUERIES``
(comma separated) replaces the headline list, ``BENCH_ALL=1`` takes every
registered query. A query that takes less than ``REPEAT_BELOW`` seconds runs
three times: ``queries`` has the medians, ``cold`` the first runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.inputs import cleaned_trips, raw_trips  # noqa: E402
from checks.queries import QUERIES  # noqa: E402
from curbmeter.plans.forecasting import evaluate, forest  # noqa: E402
from curbmeter.session import build_session  # noqa: E402

RUNS = 3
REPEAT_BELOW = 8.0
HEADLINE = [
    "describe_numeric",
    "null_profile",
    "iqr_audit",
    "domain_values",
    "duplicate_count",
    "quality_report",
    "reject_funnel",
    "clean_trips",
    "time_features",
    "demand_cube",
    "hourly_by_daytype",
    "weekday_hour_matrix",
    "top_pickup_zones",
    "top5_zone_hourly",
    "od_flows",
    "distance_fare_sample",
    "fare_quantiles",
    "fare_by_passengers",
    "payment_share",
    "tip_rate",
    "hourly_payment_share",
    "payment_means",
    "hourly_demand_answer",
    "location_ranking",
    "route_info",
    "route_table",
    "payment_analysis",
    "tag_questions",
    "encoded_cube",
    "scaled_features",
    "error_metrics",
    "residual_histogram",
    "model_comparison",
    "score_requests",
]


def forest_full(spark, sf_dir):
    """The forest with its full settings: 100 trees of depth 15."""
    return evaluate(cleaned_trips(spark, sf_dir), {"forest": forest()})["forest"]


def run(df) -> None:
    """Compute every row without moving them to the driver."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    if os.environ.get("BENCH_QUERIES"):
        names = os.environ["BENCH_QUERIES"].split(",")
    else:
        names = list(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    catalogue = {**QUERIES, "forest_full": forest_full}
    seconds, cold = {}, {}
    start = time.perf_counter()
    raw_trips(spark, sf_dir)
    seconds["derive_trips"] = time.perf_counter() - start
    start = time.perf_counter()
    cleaned_trips(spark, sf_dir)
    seconds["clean_dedup_write"] = time.perf_counter() - start
    for name in names:
        taken = []
        while not taken or len(taken) < RUNS and taken[0] < REPEAT_BELOW:
            start = time.perf_counter()
            run(catalogue[name](spark, sf_dir))
            taken.append(time.perf_counter() - start)
        cold[name], seconds[name] = taken[0], statistics.median(taken)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": {name: round(value, 3) for name, value in seconds.items()},
                "cold": {name: round(value, 3) for name, value in cold.items()},
                "cores": int(cpus),
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
