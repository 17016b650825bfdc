import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stratalens.operators import events, manifest, params, sampling
from stratalens.sources.schema import SCENARIO_SCHEMA


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        person = 1 if rng.random() < 0.4 else rng.randrange(2, 200)
        rows.append((i, person, round(rng.random() * 400, 2), rng.choice(["PrEP_Received", "PrEP_Expired"])))
    return spark.createDataFrame(rows, "event_id int, person int, age double, name string").persist()


def durations(log, hot_rows):
    df = events.use_durations(log, "person", "age", "name", "PrEP_Received", "event_id", ("event_id",), hot_rows)
    return sorted(tuple(r) for r in df.collect())


def test_a_hot_person_is_sliced_without_changing_the_result(log):
    people = {}
    for r in log.collect():
        people.setdefault(r.person, []).append((r.age, r.event_id, r.name))
    want = []
    for person, rows in people.items():
        rows.sort()
        want += [
            (person, i, a, b[0], b[0] - a) for (a, i, n), b in zip(rows, rows[1:]) if n == "PrEP_Received"
        ]
    assert durations(log, 10**6) == sorted(want)
    assert durations(log, 50) == sorted(want)


def test_hot_groups_are_few(log):
    from stratalens.operators.neighbours import hot_groups

    assert [r.person for r in hot_groups(log, ["person"], "age", 200).collect()] == [1]


def test_histogram(spark):
    df = spark.createDataFrame([(0.0,), (15.21,), (15.3,), (30.42,), (45.7,), (390.0,), (391.0,), (-1.0,)], "duration double")
    got = {r.bin: r.n for r in events.duration_histogram(df).collect()}
    assert got == {0: 2, 1: 2, 2: 1, 13: 1}
    assert sum(r.share for r in events.duration_histogram(df).collect()) == pytest.approx(1.0)


def test_uniqueness(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (2, 5), (2, 6)], "node int, person int")
    assert tuple(events.id_uniqueness(df, "node", "person").first()) == (3, 2)


@pytest.fixture(scope="module")
def sets(spark):
    return spark.createDataFrame(
        [(i, math.log(0.1 + i), 3.0 - i, 1.0 + i, 0.3, None if i else 0.4, 0.2, 5.0, float((i * 7) % 11)) for i in range(12)],
        "parameterization_id bigint, `LOG Base Infectivity` double, PreARTLinkMinimum double, PreARTLinkMaximum double,"
        " RiskAssortivity double, `Risk Ramp Rate` double, SiayaPropLowRisk double, `A B` double, likelihood double",
    )


def test_mapping(sets):
    got = params.map_to_inputs(sets.drop("likelihood"), {"A B": ["CONFIG.X", "Y"]})
    one = {(r.target, r.position): r.value for r in got.where("parameterization_id = 0").collect()}
    low = "Actual_IndividualIntervention_Config__KP_PreART_Link.Ramp_"
    assert one[("Base_Infectivity", 0)] == pytest.approx(0.1)
    assert (one[(low + "Min", 0)], one[(low + "Max", 0)]) == (1.0, 3.0)
    assert [one[("Initial_Distribution__KP_Risk_Siaya", i)] for i in range(3)] == [0.2, 0.8, 0.0]
    matrix = [one[("Weighting_Matrix_RowMale_ColumnFemale__KP_RiskAssortivity", i)] for i in range(9)]
    assert matrix == [0.3, 0.7, 0.0, 0.7, 0.3, 0.3, 0.0, 0.3, 0.7]
    assert (one[("X", 0)], one[("Y", 0)]) == (5.0, 5.0)
    ramps = [k for k in one if "Medium_Risk" in k[0]]
    assert len(ramps) == 6
    assert got.where("parameterization_id = 3 AND target LIKE '%Medium_Risk%'").count() == 0


def test_unmapped(sets):
    long = params.unpivot_params(sets)
    assert params.unmapped_parameters(long, {"A B": "X"}).count() == 0
    assert [r.parameter for r in params.unmapped_parameters(long, {}).collect()] == ["A B"]


def test_constraints_and_ranges(spark):
    df = spark.createDataFrame([(0.5, 0.3, 9.0)], "ProbExtraTransitoryMaleLow double, ProbExtraTransitoryMaleMedium double, other double")
    assert tuple(params.constrain_sample(df).first()) == (0.3, 0.3, 9.0)
    assert tuple(params.constrain_sample(df.drop("ProbExtraTransitoryMaleMedium")).first()) == (0.5, 9.0)
    assert tuple(params.ordered_range(df, ("other", "ProbExtraTransitoryMaleLow"), "lo", "hi").select("lo", "hi").first()) == (0.5, 9.0)


def test_box_whiskers(spark):
    long = spark.createDataFrame([("p", "AB", float(v)) for v in (1, 2, 3, 4, 5, 6, 7, 50)], "parameter string, source string, value double")
    row = params.box_statistics(long).first()
    assert (row["min"], row.q1, row.median, row.q3, row["max"]) == (1.0, 2.75, 4.5, 6.25, 50.0)
    assert (row.whisker_low, row.whisker_high, row.n_outliers) == (1.0, 7.0, 1)


def test_override(spark):
    base = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "key string, value double")
    own = spark.createDataFrame([(7, "b", 9.0), (7, "c", 3.0), (8, "a", 0.0)], "parameterization_id int, key string, value double")
    got = {(r[0], r[1]): r[2] for r in params.override_config(base, own).collect()}
    assert got == {(7, "a"): 1.0, (7, "b"): 9.0, (7, "c"): 3.0, (8, "a"): 0.0, (8, "b"): 2.0}


def test_overrides_of_any_type_and_sets_without(spark):
    base = params.config_entries(spark.createDataFrame([('{"n": 1.5, "s": "x", "a": [1, "y"], "z": null}',)], "config string"))
    assert {tuple(r) for r in base.collect()} == {("n", "1.5"), ("s", '"x"'), ("a", '[1,"y"]'), ("z", "null")}
    own = spark.createDataFrame([(7, "n", None), (7, "s", '"w"')], "parameterization_id int, key string, value string")
    ids = spark.createDataFrame([(7,), (8,)], "parameterization_id int")
    got = {(r[0], r[1]): r[2] for r in params.override_config(base, own, ids).collect()}
    assert got == {
        (7, "n"): None, (7, "s"): '"w"', (7, "a"): '[1,"y"]', (7, "z"): "null",
        (8, "n"): "1.5", (8, "s"): '"x"', (8, "a"): '[1,"y"]', (8, "z"): "null",
    }


def test_nan_is_not_fanned_out(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 0.5)], "parameterization_id int, `Risk Reduction Fraction` double")
    got = params.map_to_inputs(df, {}).collect()
    assert {r.parameterization_id for r in got} == {2} and len(got) == 6


def test_events_without_a_time_are_no_events(spark):
    df = spark.createDataFrame([(1, None, "go", 1), (1, 2.0, "go", 2), (1, 5.0, "stop", 3), (1, None, "stop", 4)], "p int, t double, name string, k int")
    got = events.use_durations(df, "p", "t", "name", "go", "k").collect()
    assert [(r.start, r.end, r.duration) for r in got] == [(2.0, 5.0, 3.0)]


def test_overlay_documents(spark):
    text = '{"Nodes": [{"NodeID": 1, "NodeName": "Siaya", "IndividualProperties": [{"Property": "Risk", "Values": ["LOW", "HIGH"], "Initial_Distribution": [0.9, 0.1]}, {"Property": "Access", "Values": ["Yes"], "Initial_Distribution": [1]}]}]}'
    got = params.explode_overlay(spark.createDataFrame([(text,)], "overlay string"))
    assert {tuple(r) for r in got.collect()} == {(1, "Siaya", "Risk", "LOW", 0.9), (1, "Siaya", "Risk", "HIGH", 0.1), (1, "Siaya", "Access", "Yes", 1.0)}


def test_seeds_repeat_and_stay_in_range(spark):
    df = spark.range(2000)
    a = [r[0] for r in df.select(params.run_seed(F.col("id"), 1)).collect()]
    assert a == [r[0] for r in df.select(params.run_seed(F.col("id"), 1)).collect()]
    assert min(a) >= 0 and max(a) <= 65535 and len(set(a)) > 1900
    assert a != [r[0] for r in df.select(params.run_seed(F.col("id"), 2)).collect()]


def test_roulette(sets):
    got = sampling.roulette_sample(sets.drop("A B"), 9, seed=4).collect()
    assert sorted(r.parameterization_id for r in got) == list(range(9))
    assert len({r.source_id for r in got}) == 9
    top = sorted((r.parameterization_id, r.likelihood) for r in got if r.selected_by == "top")
    assert [x for _, x in top] == [10.0, 9.0, 8.0]
    least = {r.source_id for r in sampling.roulette_sample(sets, 10, seed=4, drop_last=True).collect()}
    # Two sets have no likelihood: one is dropped as the last, the other cannot be drawn.
    assert len(least) == 10 and least.isdisjoint({0, 11})
    with pytest.raises(PySparkException, match="fewer than 12"):
        sampling.roulette_sample(sets, 12, seed=4, drop_last=True).collect()


def test_a_short_draw_is_an_error(spark):
    df = spark.createDataFrame([(i, 1.0 if i < 10 else 0.0) for i in range(30)], "parameterization_id bigint, likelihood double")
    assert sampling.roulette_sample(df, 9).count() == 9
    for wrong in (df, df.withColumn("likelihood", F.lit(0.0))):
        with pytest.raises(PySparkException, match="fewer than 21"):
            sampling.roulette_sample(wrong, 21).collect()


def test_heavier_sets_are_drawn_more_often(spark):
    df = spark.createDataFrame([(0, 1000.0)] + [(i, 30.0 if i == 1 else 1.0) for i in range(1, 21)], "parameterization_id bigint, likelihood double")
    drawn = [r.source_id for s in range(20) for r in sampling.roulette_sample(df, 2, seed=s).where("selected_by = 'roulette'").collect()]
    assert len(drawn) == 20 and drawn.count(1) >= 6


def test_numbering_and_appending(spark):
    ids = [3, 70_000, 65_535, 65_536, 200_001]
    df = spark.createDataFrame([(i, float(i)) for i in ids], "parameterization_id bigint, p double")
    got = {r.parameterization_id: r.n for r in sampling.number_rows(df, "parameterization_id", "n", 251).collect()}
    assert got == {i: 251 + k for k, i in enumerate(sorted(ids))}
    sparse = spark.range(3000).select((F.col("id") * 3_000_000_000_000).alias("i"))
    assert sampling.number_rows(sparse, "i", "n").where("n <> i div 3000000000000").count() == 0
    runs = spark.createDataFrame([(3,), (70_000,), (None,)], "run_num int")
    old = spark.createDataFrame([(1, 0.5)], "parameterization_id bigint, q double")
    rows = sampling.append_selected(df, runs, old).collect()
    assert [(r.parameterization_id, r.p, r.q) for r in rows] == [(1, None, 0.5), (251, 3.0, None), (252, 70_000.0, None)]


def test_manifest(spark):
    table = spark.createDataFrame([("PrEP-0", "a.json"), ("PrEP-10", None), (None, "b.json")], SCENARIO_SCHEMA)
    samples = spark.createDataFrame([(1, 0.5), (2, 0.6)], "parameterization_id int, p double")
    resolved = manifest.resolve_campaigns(table, {"Base": ["a.json", "b.json"], "One": ["a.json"]})
    with pytest.raises(PySparkException, match="campaign"):
        manifest.expand_runs(samples, resolved).collect()
    got = {(r.parameterization_id, r.scenario, r.campaign_file) for r in manifest.expand_runs(samples, resolved, strict=False).collect()}
    assert got == {
        (i, s, c) for i in (1, 2) for s, c in (
            ("Base-a-PrEP-0", "a.json"), ("Base-b", "b.json"), ("One-a-PrEP-0", "a.json"), ("One-Default_Campaign-PrEP-10", "a.json"))
    }


def test_scenario_columns_override_sample_columns(spark):
    table = spark.createDataFrame([("S", "a.json", 9.0)], "Scenario string, Campaign string, p double")
    samples = spark.createDataFrame([(1, 0.5)], "parameterization_id int, p double")
    row = manifest.expand_runs(samples, manifest.resolve_campaigns(table, {"B": ["a.json"]})).first()
    assert row.p == 9.0 and row.config_name == "B-a-S"


def test_strict_errors_surface(spark):
    with pytest.raises(PySparkException):
        spark.range(1).select(F.raise_error(F.lit("x"))).collect()


def test_two_overrides_of_one_key_fail(spark):
    base = spark.createDataFrame([("k", "1")], "key string, value string")
    own = spark.createDataFrame([(1, "k", "2"), (1, "k", None)], "parameterization_id int, key string, value string")
    with pytest.raises(PySparkException, match="two overrides of k"):
        params.override_config(base, own).collect()
