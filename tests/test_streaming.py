"""Scenarios that finish over several starts of the watch."""

import time
from pathlib import Path

import pytest

from stratalens.streaming import completion

FIELDS = "scenario string, run_num int, replicate string"


def deliver(folder, *runs, batch="a"):
    for scenario, run, value in runs:
        path = Path(folder) / batch / scenario / f"Report_TPI{run:04d}_REP0001.csv"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"Year,Population\n2000,{value}\n")
        time.sleep(0.01)


@pytest.fixture
def watch(spark, tmp_path):
    expected = spark.createDataFrame([("s", 1, "1"), ("s", 2, "1"), ("s", 2, "1"), ("t", 1, "1"), ("u", 7, "1")], FIELDS)

    def run(**options):
        completion.watch_runs(spark, str(tmp_path / "in"), expected, str(tmp_path / "out"), str(tmp_path / "done"), **options).awaitTermination()
        noted = completion.arrivals(spark, str(tmp_path / "out"))
        status = {r.scenario: r for r in completion.scenario_status(expected, noted).collect()}
        done = {r.scenario: r.batch for r in completion.finished(spark, str(tmp_path / "out")).collect()}
        return status, done, {(r.scenario, r.run_num) for r in completion.missing_runs(expected, noted).collect()}

    run.expected, run.folder, run.target = expected, str(tmp_path / "in"), str(tmp_path / "out")
    return run


def test_late_repeated_missing_and_unexpected_runs(spark, watch):
    deliver(watch.folder, ("s", 1, 10), ("t", 1, 20), ("t", 9, 1))
    status, done, missing = watch()
    assert done == {"t": 0} and missing == {("s", 2), ("u", 7)}
    assert (status["t"].n_unexpected, status["t"].complete, status["s"].n_arrived) == (1, True, 1)
    # A second start finds a late run, a run that comes again and an older file of a run that has a newer one.
    deliver(watch.folder, ("s", 2, 30), ("s", 1, 11), batch="b")
    status, done, missing = watch()
    assert done == {"t": 0, "s": 1} and missing == {("u", 7)} and status["s"].n_replaced == 1
    noted = completion.arrivals(spark, watch.target)
    newest = {(r.scenario, r.run_num): (r.version, "/b/" in r.file) for r in completion.current_files(noted).collect()}
    assert newest == {("s", 1): (2, True), ("s", 2): (1, True), ("t", 1): (1, False), ("t", 9): (1, False)}
    # Nothing new: nothing changes.
    assert watch()[1] == done and completion.arrivals(spark, watch.target).count() == noted.count()
    # A finished scenario whose file is replaced is not finished again.
    deliver(watch.folder, ("t", 1, 21), batch="c")
    assert watch()[1] == done
    assert completion.arrivals(spark, watch.target).where("scenario = 't' AND version = 2").count() == 1


def test_one_file_at_a_time(watch):
    deliver(watch.folder, ("s", 1, 1), ("s", 2, 1), ("t", 1, 1), ("s", 1, 2))
    status, done, _ = watch(max_files=1)
    assert set(done) == {"s", "t"} and status["s"].n_arrived == 2


def test_a_batch_that_is_repeated_writes_the_same(spark, tmp_path):
    expected = spark.createDataFrame([("s", 1, "1"), ("t", None, "x")], FIELDS)
    row = "scenario string, run_num int, replicate string, version int, file string, modified timestamp"
    events = [spark.createDataFrame([x], row) for x in (("s", 1, "1", 1, "f", None), ("t", None, "x", 1, "g", None))]
    for batch in (0, 0, 1, 1, 0):
        completion.settle(events[batch], batch, expected, str(tmp_path))
        assert completion.arrivals(spark, str(tmp_path)).where(f"batch = {batch}").count() == 1
    done = completion.finished(spark, str(tmp_path)).collect()
    assert sorted((r.scenario, r.batch, r.n_expected) for r in done) == [("s", 0, 1), ("t", 1, 1)]


def test_nothing_arrived_yet(spark, tmp_path):
    expected = spark.createDataFrame([("s", 1, "1")], FIELDS)
    none = completion.arrivals(spark, str(tmp_path))
    assert none.count() == 0 and completion.finished(spark, str(tmp_path)).count() == 0
    assert completion.missing_runs(expected, none).count() == 1
    assert completion.scenario_status(expected.limit(0), none).count() == 0
