"""From report strata to calibration outputs, in one pass each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.operators.measures import MeasureSpec, evaluate_all
from stratalens.operators.persontime import add_person_years
from stratalens.operators.standardize import finest_strata
from stratalens.operators.summary import summarise_runs
from stratalens.sources.schema import DIMENSIONS, run_keys_of

STRATA = ("year", "county", "gender", "age_lower", "age_upper", "hiv", "circ", "risk")


def in_survey_ages(df: DataFrame, observed: DataFrame) -> DataFrame:
    """Rows whose lower age bound also occurs in the survey."""
    known = observed.select(F.col("age_lower").cast("int")).distinct()
    return df.join(known, "age_lower", "left_semi")


def measure_suite(
    df: DataFrame, specs: Sequence[MeasureSpec], counts: Sequence[str],
    run_keys: Sequence[str] | None = None, strata: Sequence[str] = STRATA,
) -> DataFrame:
    """All outputs of a report, by run: rows are summed once to the strata that the
    outputs mention, then every output is taken from those in one more aggregation."""
    run_keys = run_keys_of(df, run_keys)
    named = set().union(*[s.names() for s in specs])
    kept = [c for c in strata if c in df.columns and c in named]
    sums = [c for c in counts if c in named]
    return evaluate_all(finest_strata(df, [*run_keys, *kept], sums), specs, run_keys)


def summarise_suite(
    by_run: DataFrame, keys: Sequence[str] = ("scenario", "output"), runs_bound: int | None = None
) -> DataFrame:
    return summarise_runs(by_run, [*keys, *DIMENSIONS], runs_bound=runs_bound)


def incidence_suite(
    df: DataFrame, specs: Sequence[MeasureSpec], interval: float, method: str, anchor: str,
    run_keys: Sequence[str] | None = None, drop_missing: bool | None = None,
    strata: Sequence[str] = ("node_id", "gender", "risk", "hiv", "age_lower"),
) -> DataFrame:
    """Person-time, then every incidence-type output in one aggregation."""
    run_keys = run_keys_of(df, run_keys)
    timed = add_person_years(df, interval, method, anchor, strata, run_keys, drop_missing)
    return evaluate_all(timed, specs, run_keys)


def model_and_trial(summary: DataFrame, trial: Sequence[tuple]) -> DataFrame:
    """Pooled model incidence by risk group above the rows of a trial.

    ``trial`` rows are ``(year, value, lower, upper, source)``.
    """
    model = summary.select(
        "scenario", "year", F.format_string("Model: %s risk", "risk").alias("source"),
        F.col("median").alias("value"), "lower", "upper",
    )
    rows = summary.sparkSession.createDataFrame(
        list(trial), "year double, value double, lower double, upper double, source string"
    )
    return model.unionByName(rows, allowMissingColumns=True)
