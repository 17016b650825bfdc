import math
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.functions import intervals, ratios, recode
from stratalens.functions.binomial import binomial_bounds, exact_bounds


def values(df):
    return [tuple(r) for r in df.collect()]


def test_ratios_over_zero(spark):
    df = spark.createDataFrame([(1.0, 2.0), (0.0, 0.0), (3.0, 0.0), (None, 2.0)], "a double, b double")
    got = values(df.select(ratios.ratio(F.col("a"), F.col("b")), ratios.ratio0(F.col("a"), F.col("b"))))
    assert got == [(0.5, 0.5), (None, 0.0), (None, 0.0), (None, None)]


def test_sums_over_nothing_and_over_missing(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "v double")
    assert df.agg(ratios.sum_strict(F.col("v"))).first()[0] is None
    assert df.where("v > 0").agg(ratios.sum_strict(F.col("v"))).first()[0] == 1.0


def test_a_number_over_zero_is_infinite_only_where_asked(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (1.0, 2.0)], "a double, b double")
    got = values(df.select(ratios.ratio_or_infinity(F.col("a"), F.col("b")), ratios.ratio(F.col("a"), F.col("b"))))
    assert got == [(float("inf"), None), (None, None), (0.5, 0.5)]


def test_list_texts(spark):
    df = spark.createDataFrame([('["a","b"]',), ("[[1,2],[3,4]]",), ("5",), ("plain \\ \"text\"",)], "t string")
    assert values(df.limit(1).select(recode.list_or_null(F.col("t"), "string"))) == [(["a", "b"],)]
    nested = df.where("t LIKE '[[%'").select(recode.list_or_null(F.col("t"), "array<int>"))
    assert values(nested) == [([[1, 2], [3, 4]],)]
    shown = values(df.select(F.to_json(recode.list_or_scalar(F.col("t")))))
    assert shown == [('["a","b"]',), ("[[1,2],[3,4]]",), ("5",), ('"plain \\\\ \\"text\\""',)]
    with pytest.raises(Exception):
        df.limit(1).select(recode.list_or_null(F.lit("[1,"), "int")).collect()


def test_calendar_years_differ_at_whole_years(spark):
    df = spark.createDataFrame([(2000.0,), (2000.25,), (2000.99,)], "year double")
    got = values(df.select(intervals.year_of_start(F.col("year")), intervals.year_of_end(F.col("year"))))
    assert got == [(2000.0, 1999.0), (2000.0, 2000.0), (2000.0, 2000.0)]


def test_interval_anchor(spark):
    df = spark.createDataFrame([(2000.0,)], "year double")
    opened = intervals.add_interval(df, 1 / 12, "start").first()
    closed = intervals.add_interval(df, 1 / 12, "end").first()
    assert (opened.year_start, opened.year_end, opened.year_floor) == (2000.0, 2000.08, 2000.0)
    assert closed.year_end == 2000.0 and closed.year_floor == 1999.0
    with pytest.raises(ValueError):
        intervals.add_interval(df, 0.5, "middle")


def test_age_upper_of_each_binning(spark):
    df = spark.createDataFrame([(0,), (1,), (15,), (16,), (25,), (36,), (80,), (100,)], "a int")
    got = values(df.select(*[recode.age_upper(F.col("a"), b) for b in ("calibration", "incidence", "sweep")]))
    assert got == [
        (1, 16, 16), (5, 6, 6), (20, 20, 20), (21, 18, 36), (30, 36, 30), (41, 100, 100),
        (100, 85, 85), (105, 105, 105),
    ]


def test_adult_split_uses_the_old_lower_bound(spark):
    df = spark.createDataFrame([(10,), (15,), (40,)], "a int")
    assert values(df.select(*recode.adult_split(F.col("a")))) == [(0, 15), (15, 100), (15, 100)]


def test_strings(spark):
    df = spark.createDataFrame(
        [("[15:50)", "Base-PrEP-30", "[1,2,3]", "campaign_a.json"), ("All", "Base-6mo-x", "7", "plain")],
        "bin string, s string, list string, file string",
    )
    got = values(
        df.select(
            recode.age_bin_bound(F.col("bin"), 1), recode.age_bin_bound(F.col("bin"), 2),
            recode.scenario_coverage(F.col("s")), recode.scenario_method(F.col("s")),
            recode.list_or_null(F.col("list")), recode.file_stem(F.col("file")),
        )
    )
    assert got == [
        (15, 50, 30, "Const_90", [1.0, 2.0, 3.0], "campaign_a"),
        (None, None, None, "Const_180", None, "plain"),
    ]


def test_labels(spark):
    df = spark.createDataFrame([(0, 5, 2008.5, 251, "HIGH", "Male")], "lo int, hi int, y double, r int, k string, g string")
    row = df.select(
        recode.age_label(F.col("lo"), F.col("hi")), recode.age_label(F.lit(5), F.lit(10)),
        recode.survey_source(F.col("y")), recode.run_source(F.col("r")), recode.risk_label(F.col("k")),
        recode.gender_from_survey(F.col("g")), recode.gender_from_survey(F.lit("Both")), recode.gender_two_way(F.lit("Both")),
        recode.sort_key(F.lit("Const_90"), ("Exp_90", "Const_90")), recode.sort_key(F.lit("x"), ("y",)),
        recode.strip_parameter_prefix(F.lit("CONFIG.Base")),
    ).first()
    assert tuple(row) == ("0-1", "5-9", "DHS", "AB", "High", "Men", "Both", "Women", 2, None, "Base")


def tail(x, n, p):
    """P(X >= x) by brute force."""
    return sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(x, n + 1))


def brute_bounds(x, n):
    def solve(f):
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if f(mid) else (low, mid)
        return (low + high) / 2

    lower = 0.0 if x == 0 else solve(lambda p: tail(x, n, p) < 0.025)
    upper = 1.0 if x == n else solve(lambda p: 1 - tail(x + 1, n, p) > 0.025)
    return lower, upper


def test_exact_bounds_against_brute_force():
    pairs = [(x, n) for n in (1, 2, 7, 30) for x in range(n + 1)]
    low, high = exact_bounds(*np.array(pairs, float).T)
    for (x, n), a, b in zip(pairs, low, high):
        assert (a, b) == pytest.approx(brute_bounds(x, n), abs=1e-9)
    low, high = exact_bounds([5.0, 0.0, 7.0], [10.0, 0.0, 3.0])
    assert math.isnan(low[2]) and math.isnan(high[2])
    assert (round(low[0], 6), round(high[0], 6)) == (0.187086, 0.812914)
    assert math.isnan(low[1]) and math.isnan(high[1])


def test_exact_bounds_of_large_counts_stay_ordered():
    low, high = exact_bounds([3e5, 1.5, 9e4], [1e6, 400.25, 1e5])
    share = np.array([0.3, 1.5 / 400.25, 0.9])
    assert (low < share).all() and (share < high).all() and (high - low < 0.02).all()


def test_bounds_once_per_distinct_pair(spark):
    df = spark.createDataFrame([(5.0, 10.0)] * 3 + [(0.0, 0.0), (None, 4.0)], "successes double, trials double")
    got = {(r.successes, r.trials): (r.exact_lower, r.exact_upper) for r in binomial_bounds(df).collect()}
    assert set(got) == {(5.0, 10.0), (0.0, 0.0)} and got[(0.0, 0.0)] == (None, None)
