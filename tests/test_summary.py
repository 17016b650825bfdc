import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stratalens.operators import contrast
from stratalens.operators.quantiles import ACCURACY, WHOLE, exact_quantiles
from stratalens.operators.summary import first_year_reaching, summarise_runs

PROBS, NAMES = (0.5, 0.025, 0.975), ("median", "lower", "upper")


@pytest.mark.parametrize("bound", [10, None])
def test_type_seven_quantiles(spark, bound):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 4.0, 8.0, 16.0, None)], "k string, v double")
    row = exact_quantiles(df, ["k"], "v", PROBS, NAMES, "mean", bound).first()
    assert (row["mean"], row["median"]) == (6.2, 4.0)
    assert row["lower"] == pytest.approx(1.1) and row["upper"] == pytest.approx(15.2)


@pytest.mark.parametrize("bound", [10, None])
def test_groups_of_missing_values_stay(spark, bound):
    df = spark.createDataFrame([("a", None), (None, 3.0)], "k string, v double")
    got = {r.k: (r["mean"], r["median"]) for r in exact_quantiles(df, ["k"], "v", PROBS, NAMES, "mean", bound).collect()}
    assert got == {"a": (None, None), None: (3.0, 3.0)}


def test_ranked_quantiles_of_a_group_that_is_sketched(spark):
    n = 5 * ACCURACY
    rng = np.random.default_rng(3)
    smooth = rng.normal(size=n)
    steps = np.floor(rng.exponential(size=n) * 3)
    one = np.where(np.arange(n) < n * 0.97, 1.0, np.arange(n))
    frames = {"smooth": smooth, "steps": steps, "one": one}
    df = spark.createDataFrame(
        [(k, float(x)) for k, v in frames.items() for x in v] + [("small", 2.0), ("small", 5.0)], "k string, v double"
    )
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", PROBS, NAMES).collect()}
    for k, v in frames.items():
        assert [got[k][n] for n in NAMES] == pytest.approx(list(np.quantile(v, PROBS)), rel=1e-12)
    assert got["small"]["median"] == 3.5


def test_groups_on_both_sides_of_what_an_aggregation_holds(spark):
    def values(n, k):
        return [float((x * 7919 + k) % n) - n / 3 for x in range(n)]

    sizes = {"at": WHOLE, "over": WHOLE + 1, "tiny": 3, None: 4}
    rows = [(k, v) for k, n in sizes.items() for v in values(n, len(k or ""))] + [("none", None), ("tiny", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", PROBS, NAMES, "mean").collect()}
    for k, n in sizes.items():
        v = values(n, len(k or ""))
        assert [got[k][x] for x in NAMES] == pytest.approx(list(np.quantile(v, PROBS)), rel=1e-12)
        assert got[k]["mean"] == pytest.approx(np.mean(v))
    assert got["none"]["median"] is None and len(got) == 5
    small = exact_quantiles(df.where("k IN ('tiny', 'none')"), ["k"], "v", PROBS, NAMES)
    assert "Window" not in small._jdf.queryExecution().executedPlan().toString()
    assert exact_quantiles(df.limit(0), ["k"], "v", PROBS, NAMES).count() == 0


def test_strict_summary_fails_on_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None)], "k string, value double")
    assert summarise_runs(df, ["k"], runs_bound=5).first()["mean"] == 1.0
    with pytest.raises(PySparkException):
        summarise_runs(df, ["k"], on_null="raise", runs_bound=5).collect()
    with pytest.raises(ValueError):
        summarise_runs(df, ["k"], on_null="ignore")


def test_first_year_reaching(spark):
    df = spark.createDataFrame([("a", 2000.0, 0.5), ("a", 2001.0, 0.81), ("a", 2002.0, 0.95)], "k string, year double, median double")
    got = {r.target: r.target_year for r in first_year_reaching(df, ["k"], (0.81, 0.9, 0.99)).collect()}
    assert got == {0.81: 2001.0, 0.9: 2002.0, 0.99: None}


SWEEP = "run_num int, year double, prep_coverage int, value double, gender string, age_lower int, age_upper int, county string, measure string"


def sweep(spark, rows):
    return spark.createDataFrame([(*r, "Women", 16, 35, "All", "m") for r in rows], SWEEP)


ROWS = [(r, y, c, (100.0 + r) * (1 - c / 200)) for r in range(5) for y in (2021.0, 2022.0) for c in (0, 50, 100)]


@pytest.mark.parametrize("bound", [10, None])
def test_relative_risk(spark, bound):
    got = {(r.year, r.prep_coverage): r.median for r in contrast.relative_risk(sweep(spark, ROWS), runs_bound=bound).collect()}
    assert got == pytest.approx({(y, c): 1 - c / 200 for y in (2021.0, 2022.0) for c in (50, 100)})


def test_relative_risk_of_the_baseline_is_one(spark):
    rows = contrast.with_baseline(sweep(spark, ROWS), ["run_num", "year"]).where("prep_coverage = 0")
    assert rows.where("value <> value_base").count() == 0


def test_averted(spark):
    df = sweep(spark, ROWS)
    by_year = {(r.year, r.prep_coverage): r.median for r in contrast.averted_by_year(df, runs_bound=9).collect()}
    assert by_year[(2021.0, 100)] == pytest.approx(102 / 2)
    total = {r.prep_coverage: r.median for r in contrast.averted_total(df, 2021, 2022, runs_bound=9).collect()}
    assert total == pytest.approx({50: 2 * 102 / 4, 100: 102})


@pytest.mark.parametrize("extra", [[], [(0, 2021.0, 0, 9.0), (0, 2021.0, 0, 8.0)]])
def test_baseline_must_be_unique(spark, extra):
    rows = [(0, 2021.0, 50, 3.0), *extra]
    with pytest.raises(PySparkException):
        contrast.with_baseline(sweep(spark, rows), ["run_num", "year"]).collect()
    loose = contrast.with_baseline(sweep(spark, rows), ["run_num", "year"], strict=False)
    assert loose.where("prep_coverage = 50").first().value_base == (9.0 if extra else None)


def test_coverage_reached(spark):
    df = spark.createDataFrame([(2025.0, 0.5), (2026.0, 0.7)], "year double, median double")
    assert [r.percent for r in contrast.coverage_reached(df, 2025).collect()] == [50.0]


def test_a_group_larger_than_stated_fails(spark):
    from stratalens.operators.quantiles import exact_quantiles

    df = spark.range(20).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("v"))
    assert exact_quantiles(df, ["k"], "v", (0.5,), ("m",), group_bound=20).first().m == 9.5
    with pytest.raises(Exception, match="more than 19"):
        exact_quantiles(df, ["k"], "v", (0.5,), ("m",), group_bound=19).collect()
