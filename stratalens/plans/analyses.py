"""Whole analyses: from report directories to saved by-run results and summaries."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.functions.recode import scenario_coverage, scenario_method
from stratalens.operators import channels
from stratalens.operators.persontime import one_row_per_time
from stratalens.operators.standardize import standardize_report
from stratalens.plans import catalog
from stratalens.plans.calibration import in_survey_ages, incidence_suite, measure_suite, summarise_suite
from stratalens.sources.reports import scale_counts, scan_reports
from stratalens.sources.results import load_results, save_results
from stratalens.sources.schema import RUN_KEYS

SWEEP_KEYS = ("scenario", "prep_coverage", "run_num", "replicate")
METHOD_KEYS = ("scenario", "prep_coverage", "prep_method", "run_num", "replicate")


def load_reports(
    spark: SparkSession, path: str, binning: str, scale_factor: float,
    pop_adjust: float | None = None, last_scaled: str | None = None, label_risk: bool = False,
    scenario_depth: int = 3, name_depth: int = 1,
) -> tuple[DataFrame, list[str]]:
    """Standardised, scaled rows of all runs below ``path`` and their count columns."""
    raw = scan_reports(spark, path, scenario_depth=scenario_depth, name_depth=name_depth)
    counts = [c for c in raw.columns[raw.columns.index("population"):] if c not in RUN_KEYS]
    scaled = scale_counts(raw, "population", last_scaled, scale_factor, pop_adjust)
    return standardize_report(scaled, binning, label_risk), counts


def analyse_calibration(
    spark: SparkSession, path: str, scale_factor: float, pop_adjust: float,
    observed_population: DataFrame | None = None, **options,
) -> DataFrame:
    """By-run population, treatment, prevalence and circumcision outputs."""
    rows, counts = load_reports(spark, path, "calibration", scale_factor, pop_adjust, **options)
    specs = catalog.calibration_measures()
    if observed_population is None:
        return measure_suite(rows, specs, counts)
    by_age = [s for s in specs if s.measure == "Population" and "age_lower" in s.dims]
    others = [s for s in specs if s not in by_age]
    known = in_survey_ages(rows, observed_population)
    return measure_suite(rows, others, counts).unionByName(measure_suite(known, by_age, counts))


def analyse_trial_incidence(
    spark: SparkSession, path: str, scale_factor: float, pop_adjust: float, interval: float, **options
) -> DataFrame:
    """By-run incidence among women of trial age, mid-interval person-time."""
    rows, counts = load_reports(spark, path, "incidence", scale_factor, pop_adjust, **options)
    strata = ("node_id", "gender", "risk", "hiv", "age_lower")
    times = one_row_per_time(rows, (*strata, "age_upper"), counts)
    return incidence_suite(times, catalog.women_trial(), interval, "mid", "start")


def analyse_incidence(
    spark: SparkSession, path: str, scale_factor: float, interval: float,
    last_scaled: str | None = "newly_tested_negative", **options,
) -> DataFrame:
    """By-run incidence for two trial age ranges, end-of-interval person-time."""
    rows, _ = load_reports(
        spark, path, "incidence", scale_factor, None, last_scaled, label_risk=True, **options
    )
    specs = [
        *catalog.women_by_risk("ECHO", (16, 36), (16, 35), 2010),
        *catalog.women_by_risk("MPYA", (18, 26), (18, 25), 2010),
    ]
    return incidence_suite(rows, specs, interval, "end", "end")


def analyse_sweep(
    spark: SparkSession, path: str, scale_factor: float, pop_adjust: float, interval: float, **options
) -> DataFrame:
    """By-run outputs of every scenario of a coverage sweep."""
    rows, counts = load_reports(spark, path, "sweep", scale_factor, pop_adjust, **options)
    rows = rows.withColumn("prep_coverage", scenario_coverage(F.col("scenario")))
    strata = ("node_id", "gender", "hiv", "age_lower")
    times = one_row_per_time(rows, (*strata, "age_upper"), counts, SWEEP_KEYS)
    return incidence_suite(
        times, catalog.sweep_measures(), interval, "mid", "start", SWEEP_KEYS, strata=strata
    )


def analyse_methods(
    spark: SparkSession, path: str, scale_factor: float, pop_adjust: float, interval: float,
    prep_coverage: int = 100, **options,
) -> DataFrame:
    """By-run outputs of scenarios that differ in the duration of the method."""
    rows, _ = load_reports(spark, path, "sweep", scale_factor, pop_adjust, **options)
    rows = rows.withColumns(
        {"prep_coverage": F.lit(prep_coverage), "prep_method": scenario_method(F.col("scenario"))}
    )
    return incidence_suite(rows, catalog.method_measures(), interval, "end", "end", METHOD_KEYS)


def publish(
    by_run: DataFrame, path: str, keys: Sequence[str] = ("scenario", "output"), runs_bound: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Save by-run results and their summary; both are returned as read back, so the
    reports are scanned once and every later contrast starts from the saved table."""
    spark = by_run.sparkSession
    save_results(by_run, f"{path}/by_run")
    saved = load_results(spark, f"{path}/by_run")
    save_results(summarise_suite(saved, keys, runs_bound), f"{path}/summary")
    return saved, load_results(spark, f"{path}/summary")


def process_channels(
    spark: SparkSession, config: str, report_path: str, relationships_path: str | None = None,
    strict: bool = True, scenario_depth: int = 3,
) -> DataFrame:
    """Results of all configured channels for all runs.

    The run report is required, the relationship report optional: without it a
    channel that reads it has no definition.
    """
    report = scan_reports(spark, report_path, scenario_depth=scenario_depth)
    relations = None
    if relationships_path is not None:
        relations = scan_reports(spark, relationships_path, scenario_depth=scenario_depth, required=False)
    present = {channels.REPORT}
    if relations is not None and "was_marital" in relations.columns:
        present.add(channels.RELATIONSHIPS)
    names = list(json.loads(config))
    channels.check_channels(names, present)
    chosen = [channels.CHANNELS[n] for n in names]
    found = channels.channel_results(
        report, [c for c in chosen if c.source == channels.REPORT], config, strict=strict
    )
    linked = [c for c in chosen if c.source == channels.RELATIONSHIPS]
    if not linked:
        return found
    grid = channels.channel_grid(relations, linked, config, nodes=report)
    sources = channels.infection_sources(relations)
    return found.unionByName(channels.channel_results(sources, linked, config, grid=grid))
