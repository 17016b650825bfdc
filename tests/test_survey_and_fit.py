import pytest
from pyspark.sql import functions as F

from stratalens.operators import fit, observed, overlay

RAW = "Year double, County string, Gender string, AgeBin string, Population double, weight double"


def detail(spark):
    rows = [
        (y, c, g, f"[{a}:{a + 5})", float(100 * i + a + (g == "Male")), 1.0)
        for y in (2009.0, 2019.0) for i, c in enumerate(("Siaya", "Kisii"), 1) for g in ("Male", "Female") for a in (0, 5)
    ]
    return observed.standardize_observed(spark.createDataFrame(rows, RAW), "Population", "Population", ("weight",), two_way=True)


def test_standard_columns(spark):
    df = detail(spark)
    assert set(df.columns) == {"year", "county", "gender", "value", "age_lower", "age_upper", "measure"}
    assert {(r.age_lower, r.age_upper, r.gender) for r in df.collect()} == {(a, a + 5, g) for a in (0, 5) for g in ("Men", "Women")}
    share = spark.createDataFrame([(2012.0, "All", "Both", "[15:50)", 0.2, 0.1, 0.3)], "Year double, County string, Gender string, AgeBin string, art_prev double, lb double, ub double")
    row = observed.standardize_observed(share, "art_prev", "ART Proportion").first()
    assert (row.gender, row.value, row.lower, row.upper) == ("Both", 0.2, 0.1, 0.3)


def test_totals_add_up_and_the_adult_year_is_left_out(spark):
    base = detail(spark)
    df = observed.add_marginals(base, 2019).persist()
    assert df.where("gender <> 'Both'").count() == base.count()
    both = df.where("gender = 'Both'")
    kinds = {
        (r.year, r.all_c, r.all_a): (r.n, r.v)
        for r in both.groupBy(
            "year", (F.col("county") == "All").alias("all_c"), ((F.col("age_lower") == 0) & (F.col("age_upper") == 100)).alias("all_a")
        ).agg(F.count("*").alias("n"), F.sum("value").alias("v")).collect()
    }
    total = base.where("year = 2009").agg(F.sum("value")).first()[0]
    assert kinds == {
        (2009.0, False, False): (4, total), (2009.0, False, True): (2, total), (2009.0, True, False): (2, total),
        (2009.0, True, True): (1, total), (2019.0, False, False): (4, total), (2019.0, True, True): (1, total),
    }


def test_a_missing_county_is_not_the_total(spark):
    df = detail(spark).withColumn("county", F.when(F.col("county") == "Siaya", F.col("county")))
    both = observed.add_marginals(df, 2019).where("gender = 'Both' AND year = 2009 AND age_upper = 100")
    assert {r.county for r in both.collect()} == {None, "Siaya", "All"}


def test_county_total_leaves_totals_out(spark):
    df = detail(spark).unionByName(detail(spark).withColumn("county", F.lit("All")))
    got = observed.add_county_total(df).where("county = 'All'")
    want = detail(spark).agg(F.sum("value")).first()[0]
    assert got.agg(F.sum("value")).first()[0] == 2 * want


def test_bounds_and_given_bounds(spark):
    df = spark.createDataFrame([(0.5, 10, 0.1, 0.9), (0.5, 0, 0.1, 0.9)], "value double, effective_count int, lb double, ub double")
    got = sorted((round(r.lower, 6), round(r.upper, 6)) for r in observed.add_exact_bounds(df).collect())
    assert got == [(0.1, 0.9), (0.187086, 0.812914)]


def test_weighted_total(spark):
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "county string, pop double")
    values = spark.createDataFrame([("a", 0.1, 0.0, 0.2), ("b", 0.5, 0.4, 0.6)], "county string, value double, lower double, upper double")
    row = observed.weighted_total(weights, values).first()
    assert tuple(row) == pytest.approx((0.4, 0.3, 0.5))
    assert tuple(observed.weighted_total(weights, values.where("county = 'a'")).first()) == (None, None, None)


def test_split_by_sex(spark):
    s = "gender string, value double"
    prevalence = spark.createDataFrame([("Men", 0.1), ("Women", 0.2)], s)
    coverage = spark.createDataFrame([("Men", 0.5), ("Women", 0.75)], s)
    combined = spark.createDataFrame([(2015.0, 0.6)], "year double, value double")
    m = (0.1 + 0.2 * 1.5) / 0.3
    assert tuple(observed.split_coverage_by_sex(combined, prevalence, coverage).first()) == pytest.approx((2015.0, 0.6 / m, 0.6 * m))


KEYS = "year double, gender string, county string, age_lower int, age_upper int, value double"


def points(spark, rows, run=False):
    fixed = ("Women", "All", 15, 50)
    if run:
        return spark.createDataFrame([(n, y, *fixed, v) for n, y, v in rows], "run_num int, " + KEYS)
    return spark.createDataFrame([(y, *fixed, v) for y, v in rows], KEYS)


def test_squared_error(spark):
    seen = points(spark, [(2008.5, 0.2), (2012.0, 0.4)])
    model = points(spark, [(1, 2008.5, 0.3), (1, 2012.0, 0.4), (2, 2008.5000000001, 0.2), (2, 2012.0, None), (2, 2013.0, 9.0)], True)
    got = {r.run_num: r.sse for r in fit.squared_error(seen, model).collect()}
    assert got == {1: pytest.approx(0.01), 2: None}
    late = points(spark, [(2008.5, 0.2), (2050.0, 0.4)])
    assert {r.run_num: r.sse for r in fit.squared_error(late, model).collect()} == {1: pytest.approx(0.01), 2: 0.0, None: None}


def test_ties_are_kept(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate((3.0, 1.0, 2.0, 2.0, 2.0, 5.0, None))], "run_num int, sse double")
    assert sorted(r.run_num for r in fit.lowest_with_ties(df, "sse", 2).collect()) == [1, 2, 3, 4]
    assert fit.lowest_with_ties(df, "sse", 100).count() == 6


def test_overlay_and_validation(spark):
    summary = spark.createDataFrame(
        [("s", "prev_gender_age", 2008.5, "All", "Women", 15, 20, 0.2, 0.1, 0.3), ("s", "prev_gender_age", 2030.0, "All", "Women", 15, 20, 0.2, 0.1, 0.3)],
        "scenario string, output string, year double, county string, gender string, age_lower int, age_upper int, median double, lower double, upper double",
    )
    seen = points(spark, [(2008.5, 0.25)]).withColumn("age_upper", F.lit(20)).withColumns({"lower": F.lit(0.2), "upper": F.lit(0.3)})
    spec = [s for s in overlay.overlays() if s.name == "prev_gender_age"]
    got = {(r.origin, r.year, r.source, r.facet, r.value) for r in overlay.overlay(summary, {"prevalence": seen}, spec, ("scenario",)).collect()}
    assert got == {("Model", 2008.5, None, "Women / 15-19", 0.2), ("Observed", 2008.5, "DHS", "Women / 15-19", 0.25)}
    check = {r.model_year: r.inside for r in overlay.validation(summary, seen).collect()}
    assert check == {2008.5: True, 2030.0: None}


def test_overlay_names_are_unique():
    names = [s.name for s in overlay.overlays()]
    assert len(names) == len(set(names)) == 24


def test_age_order(spark):
    df = spark.createDataFrame([(10, 15), (0, 1), (1, 5), (10, 15)], "age_lower int, age_upper int")
    assert {(r.age, r.age_order) for r in overlay.age_order(df).collect()} == {("0-1", 1), ("1-4", 2), ("10-14", 3)}


def test_all_survey_ages_count(spark):
    from stratalens.plans.calibration import in_survey_ages

    rows = spark.createDataFrame([(160,), (15,), (20,)], "age_lower int")
    known = spark.createDataFrame([(160,), (15,)], "age_lower int")
    assert {r.age_lower for r in in_survey_ages(rows, known).collect()} == {160, 15}


def test_equal_numbers_of_two_scenarios_are_two_runs(spark):
    points = spark.createDataFrame([(2000.0, "Men", "A", 15, 50, 1.0)], "year double, gender string, county string, age_lower int, age_upper int, value double")
    model = spark.createDataFrame(
        [("a", 1, 2000.0, "Men", "A", 15, 50, 2.0), ("b", 1, 2000.0, "Men", "A", 15, 50, 4.0)],
        "scenario string, run_num int, year double, gender string, county string, age_lower int, age_upper int, value double",
    )
    errors = fit.squared_error(points, model)
    assert {(r.scenario, r.run_num): r.sse for r in errors.collect()} == {("a", 1): 1.0, ("b", 1): 9.0}
    assert [r.scenario for r in fit.keep_runs(model, fit.best_runs(points, model, 1)).collect()] == ["a"]
