"""Stored audits of a folder that grows: only new files are read, lost batches and replaced files do not count."""

import pytest
from pyspark.sql import functions as F

from curbmeter.operators import clean, profile
from curbmeter.plans import incremental
from curbmeter.plans.incremental import AuditState
from curbmeter.sources.months import read_months


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture()
def state(spark, trips, tmp_path):
    """Two files in a folder whose name has a blank."""
    root = tmp_path / "the months"
    changes = [{"PULocationID": z, "fare_amount": 1.5 * z} for z in (3, 4, 4, 5)]
    trips(*changes, {"fare_amount": -1.0}, {"tip_amount": None}).coalesce(1).write.parquet(str(root / "a"))
    trips({}, {"store_and_fwd_flag": " N"}, {"payment_type": 9}).drop("airport_fee").coalesce(1).write.parquet(str(root / "b"))
    return AuditState(spark, str(root), str(tmp_path / "state"))


def full(state):
    paths = [row["path"] for row in state.listing().collect()]
    return read_months(state.spark, paths)


def same_as_full_run(state):
    df, reports = full(state), state.reports()
    wanted = {
        "nulls": profile.null_profile(df),
        "signs": profile.sign_audit(df),
        "rejected": clean.reject_funnel(df),
        "domain_values": profile.domain_values(df),
        "domains": profile.domain_summary(df),
        "padding": profile.padding_audit(df),
        "consistency": clean.fare_consistency(df),
        "passenger_counts": profile.value_distribution(df),
    }
    for name, want in wanted.items():
        assert rows_of(reports[name]) == rows_of(want), name
    return df.count()


def test_second_update_reads_new_files_only(spark, trips, state, monkeypatch):
    read = []
    monkeypatch.setattr(incremental, "read_months", lambda spark, paths, **kw: read.append(list(paths)) or read_months(spark, paths, **kw))
    assert state.update() == 2 and state.update() == 0 and len(read) == 1
    assert same_as_full_run(state) == 9
    more = trips({"PULocationID": 77}, {"passenger_count": None}).withColumn("PULocationID", F.col("PULocationID").cast("long"))
    more.coalesce(1).write.parquet(state.source + "/c")
    assert state.update() == 1 and len(read) == 2 and len(read[1]) == 1 and "/c/" in read[1][0]
    assert same_as_full_run(state) == 11
    assert {(r["PULocationID"], r["demand"]) for r in state.cube().collect()} >= {(77, 1), (4, 2)}


def test_replaced_and_removed_files(spark, trips, state):
    state.update()
    trips({"fare_amount": 99.0}).coalesce(1).write.mode("overwrite").parquet(state.source + "/a")
    # Until the next update the file that is gone counts no more, and the new one not yet.
    assert state.reports()["rows"].first()["rows"] == 3 and state.pending().count() == 1
    assert state.update() == 1
    assert same_as_full_run(state) == 4


def test_lost_batch_and_two_batches_of_one_file(spark, state, monkeypatch):
    append = AuditState._append

    def lost(self, name, states, batch):
        if name == "files":
            raise RuntimeError("driver lost")
        append(self, name, states, batch)

    monkeypatch.setattr(AuditState, "_append", lost)
    with pytest.raises(RuntimeError):
        state.update()
    monkeypatch.setattr(AuditState, "_append", append)
    assert state.update() == 2
    assert same_as_full_run(state) == 9
    # Another job that listed the files before the first had ended.
    monkeypatch.setattr(AuditState, "pending", AuditState.listing)
    assert state.update() == 2
    assert same_as_full_run(state) == 9


def test_describe_and_brackets(spark, state):
    state.update()
    df = full(state)
    want = {r["column"]: r for r in profile.describe(df).collect()}
    got = {r["column"]: r for r in state.describe().collect()}
    assert set(got) == set(want)
    for c, row in want.items():
        for field in ("count", "min", "q25", "q50", "q75", "max"):
            assert got[c][field] == row[field], (c, field)
        for field in ("mean", "std"):
            assert got[c][field] == pytest.approx(row[field], abs=1e-9), (c, field)
    for r in state.quartile_brackets().collect():
        value = want[r["column"]][{0.25: "q25", 0.5: "q50", 0.75: "q75"}[r["p"]]]
        assert value is None or r["low"] <= value <= r["high"]


def test_reports_do_not_read_the_trips(spark, state):
    state.update()
    for report in state.reports().values():
        assert "fare_amount#" not in report._jdf.queryExecution().executedPlan().toString()


def test_states_are_counted_by_a_number_of_the_file(spark, state):
    paths = [row["path"] for row in state.listing().collect()]
    files = [row["file"] for row in state.listing().collect()]
    trips = read_months(spark, paths, file_column=incremental.FILE)
    numbered, names = incremental.numbered_files(trips, files)
    assert numbered.schema[incremental.FILE].dataType.typeName() == "long"
    assert numbered.join(names, incremental.FILE).groupBy("file").count().count() == 2
    # Files that share a number keep their paths.
    same, names = incremental.numbered_files(trips, files + files[:1])
    assert same.schema[incremental.FILE].dataType.typeName() == "string" and names.columns == ["file", incremental.FILE]
    assert rows_of(same) == rows_of(trips)


def test_reasons_are_numbers_while_rows_are_counted(spark, trips):
    df = trips({}, {"fare_amount": -1.0}, {"passenger_count": None, "fare_amount": 0.0})
    got = [(r["_reason"], r["_keyed"]) for r in incremental.judged(df).collect()]
    rules = [rule.reason for rule in clean.trip_rules(df)]
    assert got == [(len(rules), True), (rules.index("03 fare not positive"), True), (0, False)]
