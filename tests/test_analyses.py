import json

import pytest
from pyspark.sql import functions as F

from stratalens.operators import channels, contrast, fit
from stratalens.plans import analyses

HEADER = (
    "Year,NodeId,Gender,Age,IsCircumcised,HasHIV,IP_Key:Risk,Population,Infected,Newly Infected,On_ART,"
    "HasIntervention(PrEP),Num_MARITAL,Num_Concordant_MARITAL,Newly Tested Negative"
)
STEP = 0.25


def write_run(root, scenario, run, ages, factor=1.0, last=2023):
    folder = root / scenario / "ReportHIVByAgeAndGender"
    folder.mkdir(parents=True, exist_ok=True)
    lines = [HEADER]
    for i in range(int((last - 2020) / STEP) + 1):
        year = 2020 + i * STEP
        for node in (1, 2):
            for sex in (0, 1):
                for age in ages:
                    for hiv in (0, 1):
                        for risk in ("LOW", "HIGH"):
                            pop = 100 + 10 * run + i
                            new = factor * (4 + run) * (1 - hiv)
                            lines.append(
                                f"{year},{node},{sex},{age},{i % 2},{hiv},{risk},{pop},{pop * hiv},{new},{5 * hiv},{50 * (1 - hiv)},8,2,1"
                            )
    (folder / f"ReportHIVByAgeAndGender_TPI{run:04d}_REP0001.csv").write_text("\n".join(lines) + "\n")


@pytest.fixture(scope="module")
def sweep(tmp_path_factory):
    root = tmp_path_factory.mktemp("sweep")
    for coverage in (0, 50):
        for run in (1, 2, 3):
            write_run(root, f"Base-PrEP-{coverage}", run, (0, 16, 36), 1 - coverage / 200)
    return root


def test_sweep_from_files_to_contrasts(spark, sweep, tmp_path):
    by_run = analyses.analyse_sweep(spark, str(sweep / "*" / "*"), 0.5, 0.5, STEP)
    saved, summary = analyses.publish(by_run, str(tmp_path / "out"), ("scenario", "prep_coverage", "output"), 10)
    assert saved.select("run_num").distinct().count() == 3
    echo = saved.where("output = 'inc_echo'")
    risk = contrast.relative_risk(echo.where("year >= 2021"), runs_bound=10).collect()
    assert {r.prep_coverage for r in risk} == {50}
    assert all(r.median == pytest.approx(0.75) for r in risk)
    averted = contrast.averted_total(saved.where("output = 'new_inf_echo'"), 2021, 2022, runs_bound=10).first()
    # Two places, two risk groups, four quarters, two years; infections scaled by one.
    assert averted.median == pytest.approx(2 * 2 * 4 * 2 * 6 * 0.25)
    assert summary.where("lower > median OR median > upper").count() == 0
    cover = summary.where("output = 'prep_echo' AND prep_coverage = 0 AND year = 2021").first()
    assert cover.median == pytest.approx(saved.where("output = 'prep_echo' AND prep_coverage = 0 AND year = 2021 AND run_num = 2").first().value)


def test_methods_and_trial_ages(spark, sweep):
    path = str(sweep / "*" / "*")
    methods = analyses.analyse_methods(spark, path, 0.5, 0.5, STEP)
    assert {r.prep_method for r in methods.select("prep_method").distinct().collect()} == {"Const_90"}
    ended = analyses.analyse_incidence(spark, path, 0.05, STEP)
    assert ended.where("output = 'inc_mpya'").count() == 0
    trial = analyses.analyse_trial_incidence(spark, path, 0.03, 0.5, STEP)
    assert {r.output for r in trial.select("output").distinct().collect()} <= {
        "inc_echo_year", "inc_echo_year_risk", "inc_echo_year_low_med", "inc_echo", "inc_echo_low_med"
    }


def test_calibration_from_files_to_best_runs(spark, tmp_path):
    root = tmp_path / "cal"
    for run in (1, 2, 12):
        write_run(root, "Base", run, (0, 1, 15, 45), last=2021)
    known = spark.createDataFrame([(15,)], "age_lower int")
    by_run = analyses.analyse_calibration(spark, str(root / "*" / "*"), 0.03, 0.5, known).persist()
    assert {r.age_lower for r in by_run.where("output = 'pop_age'").select("age_lower").distinct().collect()} == {15}
    one = by_run.where("output = 'pop' AND run_num = 1 AND year = 2020").first()
    assert one.value == pytest.approx(2 * 2 * 4 * 2 * 2 * 110 * 0.5 / 0.03)
    model = by_run.where("output = 'prev_gender'")
    seen = model.where("run_num = 12").select(*fit.JOIN_KEYS, "value")
    assert fit.best_runs(seen, model, 1).count() == 3  # all runs have the same share, so all tie


CONFIG = {
    "Prevalence": {"Year": [2021], "AgeBin": [[15, 50]], "Gender": ["Both"]},
    "ExternalStableDiscordantConversionRate": {"Year": [2021], "AgeBin": [[15, 50]], "Gender": ["Both"]},
}


def test_channels_from_files(spark, sweep, tmp_path):
    path = str(sweep / "*" / "*")
    with pytest.raises(channels.UnsupportedChannelError):
        analyses.process_channels(spark, json.dumps(CONFIG), path)
    folder = tmp_path / "rel" / "Base-PrEP-0" / "Relationships"
    folder.mkdir(parents=True)
    (folder / "ReportRelationshipsAtInfection_TPI0001_REP0001.csv").write_text(
        "Year,NodeID,InfectedAgeYears,InfectedGender,WasInMaritalRelationship,WasInfectedByMaritalPartner\n"
        "2021.5,1,20,F,1,0\n2021.25,1,30,M,1,1\n2021.25,2,30,M,0,0\n"
    )
    got = analyses.process_channels(spark, json.dumps(CONFIG), path, str(tmp_path / "rel" / "*" / "*"))
    rates = {r.Node: r.Result for r in got.where("channel LIKE 'External%'").collect()}
    assert rates == {0: 0.5, 1: 0.5, 2: 0.0}
    assert got.where("channel = 'Prevalence'").agg(F.count_distinct("scenario", "run_num")).first()[0] == 6
