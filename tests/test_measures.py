import pytest
from pyspark.sql import functions as F

from stratalens.operators.measures import MeasureSpec, evaluate, evaluate_all
from stratalens.operators.persontime import add_person_years, one_row_per_time
from stratalens.operators.standardize import standardize_report
from stratalens.plans import calibration, catalog
from stratalens.sources.schema import DIMENSIONS

SCHEMA = (
    "scenario string, run_num int, node_id int, gender_code int, age_lower int, hiv int, circ int, risk string,"
    " year double, population double, infected double, newly_infected double, on_art double, has_prep double"
)
COUNTS = ["population", "infected", "newly_infected", "on_art", "has_prep"]


@pytest.fixture(scope="module")
def rows(spark):
    data = []
    for run in (1, 2):
        for node in (1, 2):
            for g in (0, 1):
                for age in (0, 16, 36):
                    for hiv in (0, 1):
                        for circ in (0, 1):
                            for step in range(8):
                                p = 100.0 * run + 10 * node + g + age + step + circ
                                data.append((
                                    "s", run, node, g, age, hiv, circ, "LOW" if node == 1 else "HIGH",
                                    2010 + step / 4, p, p * hiv, float(step + g), float(step * hiv), float(circ),
                                ))
    return standardize_report(spark.createDataFrame(data, SCHEMA), "sweep").persist()


def table(df):
    return sorted(map(str, (r.asDict() for r in df.collect())))


def test_one_pass_equals_one_by_one(spark, rows):
    specs = catalog.calibration_measures()
    whole = calibration.measure_suite(rows, specs, COUNTS).persist()
    assert {r.output for r in whole.select("output").distinct().collect()} <= {s.output for s in specs}
    for spec in specs:
        alone = evaluate(rows, spec)
        part = whole.where(F.col("output") == spec.output).drop("output").select(alone.columns)
        assert table(alone) == table(part), spec.output


def test_marginals_add_up(spark, rows):
    specs = catalog.population()
    by_run = calibration.measure_suite(rows, specs, COUNTS)
    totals = by_run.groupBy("output").agg(F.sum("value").alias("v")).collect()
    assert len({t.v for t in totals}) == 1 and len(totals) == len(specs)


def test_bins_must_lie_inside_the_range(spark, rows):
    adult = next(s for s in catalog.prevalence(15, 50) if s.output == "prev")
    one = evaluate(rows, adult).where("run_num = 1 AND year = 2010").first()
    kept = rows.where("run_num = 1 AND year = 2010 AND age_lower = 16").agg(F.sum("infected"), F.sum("population")).first()
    assert one.value == kept[0] / kept[1] and (one.age_lower, one.age_upper) == (15, 50)
    assert "age_upper < 36" in catalog.women_by_risk("X", (16, 36), (16, 35), 2010)[0].where


def test_period_pools_numerators_and_denominators(spark, rows):
    pooled = MeasureSpec("p", "m", {}, "infected", "population", labels={"year": 2010.5})
    got = evaluate(rows, pooled).where("run_num = 2").first()
    want = rows.where("run_num = 2").agg(F.sum("infected") / F.sum("population")).first()[0]
    assert got.value == want and got.year == 2010.5


def test_unknown_forms_and_dimensions_are_refused():
    with pytest.raises(ValueError):
        MeasureSpec("x", "m", {}, "a", form="mode")
    with pytest.raises(ValueError):
        MeasureSpec("x", "m", {"planet": "a"}, "a")


def strata(spark, rows):
    return one_row_per_time(rows, ("node_id", "county", "gender", "risk", "hiv", "age_lower", "age_upper"), COUNTS)


def test_mid_interval_drops_only_the_first_uninfected_interval(spark, rows):
    times = strata(spark, rows)
    timed = add_person_years(times, 0.25, "mid", "start")
    lost = times.count() - timed.count()
    assert lost == times.where("hiv = 0 AND year = 2010").count() > 0
    assert timed.where("hiv = 1 AND year = 2010").count() == times.where("hiv = 1 AND year = 2010").count()


def test_lag_stays_inside_run_and_stratum(spark, rows):
    timed = add_person_years(strata(spark, rows), 0.25, "mid", "start")
    row = timed.where("run_num = 2 AND node_id = 1 AND gender = 'Men' AND age_lower = 0 AND hiv = 0 AND year = 2010.25").first()
    # Two circumcision rows were summed: (210 + 211) at 2010 and two more a quarter later.
    assert row.person_years == ((421.0 + 423.0) / 2) * 0.25


def test_end_of_interval_person_time(spark, rows):
    times = strata(spark, rows)
    timed = add_person_years(times, 0.25, "end", "end")
    assert timed.count() == times.count()
    row = timed.where("run_num = 1 AND hiv = 1 AND node_id = 2 AND gender = 'Women' AND age_lower = 16 AND year = 2010.5").first()
    assert row.person_years == row.newly_infected * 0.25 / 2 and row.year_floor == 2010.0
    assert timed.where("year = 2010").first().year_floor == 2009.0
    with pytest.raises(ValueError):
        add_person_years(times, 0.25, "average", "end")


def test_coverage_years_come_from_report_time_and_incidence_years_from_interval_start(spark, rows):
    by_run = calibration.incidence_suite(
        strata(spark, rows), catalog.method_measures(years=(2000, 2020)), 0.25, "end", "end"
    )
    years = {r.output: r.y for r in by_run.groupBy("output").agg(F.min("year").alias("y")).collect()}
    assert years == {"inc_echo": 2009.0, "prep_echo": 2010.0}


def test_every_measure_has_the_fixed_layout(spark, rows):
    timed = add_person_years(strata(spark, rows), 0.25, "mid", "start")
    specs = [*catalog.sweep_measures(period=(2010, 2011)), *catalog.women_trial(years=(2010, 2011), pooled=(2010, 2011))]
    got = evaluate_all(timed, specs)
    assert got.columns == ["scenario", "run_num", "output", *DIMENSIONS, "value"]
    assert got.where("value < 0 OR measure IS NULL").count() == 0


def test_survey_ages(spark, rows):
    known = spark.createDataFrame([(16,), (16,)], "age_lower int")
    kept = calibration.in_survey_ages(rows, known)
    assert [r.age_lower for r in kept.select("age_lower").distinct().collect()] == [16]


def test_suppressed_share_is_zero_without_treatment(spark, rows):
    got = evaluate(rows, catalog.suppressed_share("risk = 'LOW'")).where("year = 2010")
    assert {r.value for r in got.collect()} == {0.0}
