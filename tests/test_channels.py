import itertools
import json
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stratalens.operators import channels

CONFIG = json.dumps({
    "Prevalence": {"Year": [2010, 2011.5], "AgeBin": [[0, 15], [15, 50], [0, 100]], "Gender": ["Male", "Both"]},
    "OnART": {"Year": [2011.25], "AgeBin": [[15, 50]], "Gender": ["Female"]},
    "PrevDiscordMalePositive": {"Year": [2011], "AgeBin": [[0, 100]], "Gender": ["Male"]},
    "ExternalStableDiscordantConversionRate": {"Year": [2010, 2030], "AgeBin": [[10, 20]], "Gender": ["Both", "Female"]},
})
SCHEMA = (
    "scenario string, run_num int, year double, node_id int, gender_code int, age_lower int, hiv int, population double,"
    " infected double, on_art double, num_marital double, num_concordant_marital double"
)


def make():
    steps = itertools.product((1, 2), (2009.75, 2010.0, 2010.5, 2011.0, 2011.5), (1, 2, 3), (0, 1), (0, 15, 49), (0, 1))
    for i, (run, year, node, sex, age, hiv) in enumerate(steps):
        if run == 2 and year == 2011.5:
            continue
        yield ("s", run, year, node, sex, age, hiv, float(i % 17), float(i % 5), float(i % 3), float(i % 7), float(i % 2))


DATA = list(make())


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(DATA, SCHEMA).persist()


def brute(run, years, bins, sexes, nodes, num, den, keep=lambda r: True):
    """Every grid cell by a scan of all rows."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    mine = [dict(zip(names, r)) for r in DATA if r[1] == run]
    out = {}
    for y, (lo, hi), s, n in itertools.product(years, bins, sexes, nodes):
        hit = [
            r for r in mine
            if r["year"] == y and lo <= r["age_lower"] < hi and s in (2, r["gender_code"]) and n in (0, r["node_id"]) and keep(r)
        ]
        if hit:
            top, low = sum(num(r) for r in hit), sum(den(r) for r in hit) if den else 1
            name = {0: "Male", 1: "Female", 2: "Both"}[s]
            out[(y, n, name, f"[{lo}:{hi})")] = top / low if low else 0.0
    return out


def result(df, run, channel):
    found = df.where((F.col("run_num") == run) & (F.col("channel") == channel)).collect()
    return {(r.Year, r.Node, r.Gender, r.AgeBin): r.Result for r in found}


def specs(*names):
    return [channels.CHANNELS[n] for n in names]


def test_channels_against_a_scan_of_every_cell(rows):
    got = channels.channel_results(rows, specs("Prevalence", "OnART", "PrevDiscordMalePositive"), CONFIG, strict=False).persist()
    for run in (1, 2):
        last = 2011 if run == 1 else 2011
        years = set(range(2010, last + 1)) | {2010.0, 2011.5}
        want = brute(run, years, [(0, 15), (15, 50), (0, 100)], [0, 2], [0, 1, 2, 3], lambda r: r["infected"], lambda r: r["population"])
        assert result(got, run, "Prevalence") == pytest.approx(want)
        want = brute(run, {y + 0.5 for y in range(2000, last)} | {2011.25}, [(15, 50)], [1], [0, 1, 2, 3], lambda r: r["on_art"], None)
        assert result(got, run, "OnART") == pytest.approx(want)
        want = brute(
            run, [2011], [(0, 100)], [0], [1, 2, 3], lambda r: r["num_marital"] - r["num_concordant_marital"],
            lambda r: r["num_marital"], lambda r: r["hiv"] == 1,
        )
        assert result(got, run, "PrevDiscordMalePositive") == pytest.approx(want)


def test_empty_cells_are_listed_and_fail_when_strict(rows):
    wanted = specs("Prevalence")
    empty = channels.empty_cells(rows, wanted, CONFIG)
    assert {(r.run_num, r.year) for r in empty.collect()} == {(2, 2011.5)}
    with pytest.raises(PySparkException):
        channels.channel_results(rows, wanted, CONFIG, strict=True).collect()
    whole = rows.where("run_num = 1")
    strict = channels.channel_results(whole, wanted, CONFIG, strict=True)
    assert result(strict, 1, "Prevalence") == pytest.approx(result(channels.channel_results(whole, wanted, CONFIG, strict=False), 1, "Prevalence"))


def test_channel_without_its_columns_is_skipped(rows):
    got = channels.channel_results(rows.drop("on_art"), specs("OnART"), CONFIG, strict=False)
    assert got.count() == 0 and got.columns[-5:] == list(channels.RESULT_COLUMNS)


def test_names_are_checked(spark):
    asked = spark.createDataFrame([("Prevalence",), ("Births",), ("Births",)], "channel string")
    assert [r.channel for r in channels.unsupported_channels(asked).collect()] == ["Births"]
    with pytest.raises(channels.UnsupportedChannelError):
        channels.check_channels(["Prevalence", "Births"])
    with pytest.raises(channels.UnknownSourceError):
        channels.channels_of("OtherReport")
    assert {c.name for c in channels.channels_of(channels.RELATIONSHIPS)} == {"ExternalStableDiscordantConversionRate"}


def test_external_rate_reports_zero_for_empty_cells(spark):
    rows = spark.createDataFrame(
        [("s", 1, 2010.5, 1, 12, "F", 1, 0), ("s", 1, 2010.5, 1, 12, "F", 1, 1), ("s", 1, 2011.0, 1, 12, "M", 1, 0),
         ("s", 1, 2010.5, 1, 12, "M", 0, 0), ("s", 1, 2010.5, 2, 30, "M", 1, 0)],
        "scenario string, run_num int, year double, node_id int, age int, gender string, was_marital int, by_marital_partner int",
    )
    wanted = specs("ExternalStableDiscordantConversionRate")
    grid = channels.channel_grid(rows, wanted, CONFIG)
    got = result(channels.channel_results(channels.infection_sources(rows), wanted, CONFIG, grid=grid), 1, wanted[0].name)
    assert got[(2010.0, 1, "Female", "[10:20)")] == 0.5
    # A whole year closes the year before, so the 2011.0 infection counts for 2010.
    assert got[(2010.0, 0, "Both", "[10:20)")] == pytest.approx(2 / 3)
    assert got[(2010.0, 2, "Both", "[10:20)")] == 0.0 and got[(2030.0, 0, "Both", "[10:20)")] == 0.0
    assert len(got) == 2 * 2 * 3


def test_annual_infections_move_to_mid_year(spark):
    rows = spark.createDataFrame(
        [("s", 1, y, 1, 0, 15, 0, "LOW", n, 10.0, 1.0) for y, n in ((2010.25, 1.0), (2010.5, 2.0), (2011.0, 4.0), (2011.5, 8.0))],
        "scenario string, run_num int, year double, node_id int, gender_code int, age_lower int, circ int, risk string,"
        " newly_infected double, population double, infected double",
    )
    got = {(r.year, r.newly_infected_annualized) for r in channels.annualise_infections(rows).collect()}
    assert got == {(2010.0, 7.0), (2011.0, 8.0)}
    assert not math.isnan(sum(y for y, _ in got))


def test_many_places_meet_their_own_cells_only(spark):
    rows = spark.range(2000 * 4).select(
        F.lit("s").alias("scenario"), F.lit(1).alias("run_num"), (F.col("id") % 2000 + 1).cast("int").alias("node_id"),
        F.lit(2010.0).alias("year"), (F.col("id") % 4 % 2).cast("int").alias("gender_code"), F.lit(20).alias("age_lower"),
        F.lit(1.0).alias("infected"), F.lit(4.0).alias("population"),
    )
    config = json.dumps({"Prevalence": {"Year": [2010], "AgeBin": [[15, 50]], "Gender": ["Both"]}})
    found = channels.channel_results(rows, specs("Prevalence"), config)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join Inner" in line and "node_id" in line)
    assert join.count("node_id") >= 2 and join.count("gender_code") >= 2
    counts = {r.Gender: r.n for r in found.groupBy("Gender").agg(F.count("*").alias("n")).collect()}
    assert counts["Both"] in (2000, 2001) and found.where("Result <> 0.25").count() == 0
