"""Summaries across runs: mean, median and the central 95 % of a measure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.operators.quantiles import exact_quantiles

PROBS = (0.5, 0.025, 0.975)
NAMES = ("median", "lower", "upper")


def summarise_runs(
    measures: DataFrame,
    keys: Sequence[str],
    value: str = "value",
    mean: bool = True,
    on_null: str = "skip",
    runs_bound: int | None = None,
) -> DataFrame:
    """One row per key with ``[mean,] median, lower, upper`` over the runs.

    ``on_null="skip"`` leaves missing values out; ``"raise"`` fails on the first one.
    ``runs_bound`` is the number of runs a group can hold where that is known.
    """
    if on_null not in ("skip", "raise"):
        raise ValueError(f"on_null must be skip or raise, not {on_null!r}")
    if on_null == "raise":
        missing = F.raise_error(F.lit(f"missing {value} in a strict summary")).cast("double")
        measures = measures.withColumn(value, F.coalesce(F.col(value), missing))
    return exact_quantiles(
        measures, keys, value, PROBS, NAMES, "mean" if mean else None, runs_bound
    )


def first_year_reaching(summary: DataFrame, keys: Sequence[str], targets: Sequence[float]):
    """First year in which the median reaches each target share, NULL if it never does."""
    rows = summary.select(
        *keys, "year", "median", F.explode(F.array(*[F.lit(float(t)) for t in targets])).alias("target")
    )
    reached = F.min(F.when(F.col("median") >= F.col("target"), F.col("year")))
    return rows.groupBy(*keys, "target").agg(reached.alias("target_year"))
