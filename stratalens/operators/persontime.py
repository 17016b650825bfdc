"""Person-years at risk per report row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.functions.intervals import add_interval
from stratalens.operators.neighbours import lag_within
from stratalens.sources.schema import run_keys_of

STRATA = ("node_id", "gender", "risk", "hiv", "age_lower")


def one_row_per_time(
    df: DataFrame, strata: Sequence[str], counts: Sequence[str], run_keys: Sequence[str] | None = None
) -> DataFrame:
    """Counts summed to one row per stratum and report time.

    Partial sums are taken before the shuffle, and a stratum is left with as many
    rows as the report has times, however many input rows it had.
    """
    return df.groupBy(*run_keys_of(df, run_keys), *strata, "year").agg(*[F.sum(c).alias(c) for c in counts])


def add_person_years(
    df: DataFrame,
    interval: float,
    method: str,
    anchor: str,
    strata: Sequence[str] = STRATA,
    run_keys: Sequence[str] | None = None,
    drop_missing: bool | None = None,
) -> DataFrame:
    """``person_years`` plus the interval columns.

    ``method="mid"`` uses the mean of the previous and the present population of
    the stratum, ``"end"`` the present one. In infected strata person-time is half
    an interval per new infection under both. With ``mid`` the first interval of
    each uninfected stratum has no value and is dropped unless told otherwise.
    Input must have one row per stratum and time (see ``one_row_per_time``).
    """
    if method == "mid":
        keys = [*run_keys_of(df, run_keys), *strata]
        df = lag_within(df, keys, "year", "population", "_previous")
        population = (F.col("_previous") + F.col("population")) / 2
    elif method == "end":
        population = F.col("population")
    else:
        raise ValueError(f"method must be mid or end, not {method!r}")
    uninfected = population * F.lit(interval)
    infected = F.col("newly_infected") * F.lit(interval) / 2
    df = df.withColumn(
        "person_years", F.when(F.col("hiv") == 0, uninfected).otherwise(infected)
    ).drop("_previous")
    if method == "mid" if drop_missing is None else drop_missing:
        df = df.where(F.col("person_years").isNotNull())
    return add_interval(df, interval, anchor)
