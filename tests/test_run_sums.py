"""Outputs from sums that are kept by run."""

import pytest
from pyspark.sql import functions as F

from stratalens.operators.measures import MeasureSpec
from stratalens.plans import run_sums as kept
from stratalens.plans.calibration import measure_suite
from stratalens.sources.results import stored, write_version

FIELDS = "scenario string, run_num int, replicate string, year double, gender string, age_lower int, population double, infected double"
COUNTS = ["population", "infected"]
SPECS = [
    MeasureSpec("prev_gender", "Prevalence", {"year": "year", "gender": "gender"}, "infected", "population"),
    MeasureSpec("pop", "Population", {"year": "year"}, "population", form="sum", where="age_lower >= 15"),
]


def rows_of(spark, *runs, factor=1.0):
    rows = [
        (s, r, p, 2000.0 + y, g, a, factor * (10.0 + a + y), factor * (1.0 + y) if a else None)
        for s, r, p in runs for y in (0, 1) for g in ("Men", "Women", None) for a in (0, 15, 15)
    ]
    return spark.createDataFrame(rows, FIELDS)


def shown(df):
    return sorted(map(str, df.collect()))


def add(rows, path):
    return kept.add_runs(kept.run_sums(rows, SPECS, COUNTS), path)


def test_three_batches_equal_the_full_computation(spark, tmp_path):
    path = str(tmp_path / "sums")
    batches = [[("s", 1, "1"), ("s", 2, "1")], [("s", None, "x"), ("t", 1, "1")], [(None, 1, "1"), ("s", 1, "2")]]
    for n, runs in enumerate(batches):
        assert add(rows_of(spark, *runs), path) == n
        all_rows = rows_of(spark, *sum(batches[: n + 1], []))
        assert shown(kept.kept_measures(spark, path, SPECS)) == shown(measure_suite(all_rows, SPECS, COUNTS))


def test_a_run_that_comes_again_and_a_batch_that_is_repeated(spark, tmp_path):
    path = str(tmp_path / "sums")
    add(rows_of(spark, ("s", 1, "1"), ("s", None, "1")), path)
    for _ in range(2):
        add(rows_of(spark, ("s", 1, "1"), factor=3.0), path)
        add(rows_of(spark, ("s", None, "1"), factor=5.0), path)
    wanted = rows_of(spark, ("s", 1, "1"), factor=3.0).unionByName(rows_of(spark, ("s", None, "1"), factor=5.0))
    assert shown(kept.kept_measures(spark, path, SPECS)) == shown(measure_suite(wanted, SPECS, COUNTS))


def test_a_killed_batch_an_emptied_run_and_an_empty_batch(spark, tmp_path):
    path = str(tmp_path / "sums")
    first = rows_of(spark, ("s", 1, "1"), ("t", 1, "1"))
    add(first, path)
    before = shown(kept.kept_measures(spark, path, SPECS))
    write_version(stored(kept.run_sums(rows_of(spark, ("s", 1, "1"), factor=7.0), SPECS, COUNTS), "killed"), path, kept.FOLDERS)
    add(first.limit(0), path)
    assert shown(kept.kept_measures(spark, path, SPECS)) == before
    gone = first.where("scenario = 's'")
    kept.add_runs(kept.run_sums(gone.limit(0), SPECS, COUNTS), path, runs=gone)
    assert {r.scenario for r in kept.kept_sums(spark, path).collect()} == {"t"}
    with pytest.raises(FileNotFoundError):
        kept.kept_sums(spark, str(tmp_path / "none"))


def test_finished_scenarios_other_outputs_and_strata_that_were_not_kept(spark, tmp_path):
    path = str(tmp_path / "sums")
    rows = rows_of(spark, ("s", 1, "1"), ("t", 1, "1"))
    add(rows, path)
    done = rows.where("scenario = 't'").select("scenario").distinct()
    found = kept.kept_measures(spark, path, SPECS, done)
    assert shown(found) == shown(measure_suite(rows.where("scenario = 't'"), SPECS, COUNTS))
    other = [MeasureSpec("inf", "Infected", {"gender": "gender"}, "infected", form="sum")]
    assert shown(kept.kept_measures(spark, path, other)) == shown(measure_suite(rows, other, COUNTS))
    with pytest.raises(ValueError, match="risk"):
        kept.kept_measures(spark, path, [MeasureSpec("r", "R", {"risk": "risk"}, "infected", form="sum")])


def test_a_stream_that_is_started_again(spark, tmp_path):
    source, path = str(tmp_path / "rows"), str(tmp_path / "sums")
    named = lambda df, file, at: df.withColumns({"file": F.lit(file), "modified": F.lit(at).cast("timestamp")})
    old, new = named(rows_of(spark, ("s", 1, "1"), factor=9.0), "b", 1), named(rows_of(spark, ("s", 1, "1")), "a", 2)

    def start():
        stream = spark.readStream.schema(old.schema).parquet(source)
        stream.writeStream.foreachBatch(kept.sums_sink(path, SPECS, COUNTS)).option("checkpointLocation", str(tmp_path / "taken")).trigger(
            availableNow=True).start().awaitTermination()
        return shown(kept.kept_measures(spark, path, SPECS))

    old.unionByName(new).unionByName(named(rows_of(spark, ("t", 4, "1")), "c", 1)).write.parquet(source)
    first = rows_of(spark, ("s", 1, "1"), ("t", 4, "1"))
    assert start() == shown(measure_suite(first, SPECS, COUNTS)) == start()
    named(rows_of(spark, ("t", 4, "1"), factor=2.0), "d", 3).write.mode("append").parquet(source)
    wanted = rows_of(spark, ("s", 1, "1")).unionByName(rows_of(spark, ("t", 4, "1"), factor=2.0))
    assert start() == shown(measure_suite(wanted, SPECS, COUNTS))
