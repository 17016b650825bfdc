"""Scenarios set against the baseline scenario of the same run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalens.functions.ratios import ratio_or_infinity
from stratalens.operators.summary import summarise_runs
from stratalens.sources.schema import run_keys_of

LEVEL = "prep_coverage"
DIMS = ("gender", "age_lower", "age_upper", "county", "measure")


def with_baseline(
    df: DataFrame, keys: Sequence[str], level: str = LEVEL, base: int = 0, strict: bool = True
) -> DataFrame:
    """``value_base``: the baseline value of the same run (and time).

    A group holds one row per scenario. With ``strict`` a group without exactly one
    baseline fails; otherwise its baseline is NULL or the largest of several.
    """
    group = Window.partitionBy(*keys)
    is_base = F.col(level) == base
    baseline = F.max(F.when(is_base, F.col("value"))).over(group)
    if strict:
        count = F.sum(F.when(is_base, 1).otherwise(0)).over(group)
        wrong = F.raise_error(F.lit("a group must have exactly one baseline")).cast("double")
        baseline = F.when(count == 1, baseline).otherwise(wrong)
    return df.withColumn("value_base", baseline)


def _contrast(
    df: DataFrame, keys: Sequence[str], result: Column, by: Sequence[str], level: str,
    strict: bool, runs_bound: int | None,
) -> DataFrame:
    rows = with_baseline(df, keys, level, strict=strict).where(F.col(level) > 0)
    changed = rows.withColumn("value", result)
    on_null = "raise" if strict else "skip"
    return summarise_runs(changed, [*by, level], mean=False, on_null=on_null, runs_bound=runs_bound)


def _run(df: DataFrame) -> list[str]:
    """What identifies a run in every scenario."""
    return [k for k in run_keys_of(df) if k != "scenario"]


def relative_risk(
    measures: DataFrame, by: Sequence[str] = ("year", *DIMS), time: Sequence[str] = ("year",),
    level: str = LEVEL, strict: bool = True, runs_bound: int | None = None,
) -> DataFrame:
    """Median and interval of value / baseline value over runs. Without ``time`` the
    rows are pooled periods and a run is its own group. A value over a baseline of zero is
    infinite; ``strict`` fails where both are zero or one is missing."""
    rr = ratio_or_infinity(F.col("value"), F.col("value_base"))
    return _contrast(measures, [*_run(measures), *time], rr, by, level, strict, runs_bound)


def averted_by_year(
    measures: DataFrame, by: Sequence[str] = (), level: str = LEVEL, strict: bool = True,
    runs_bound: int | None = None,
) -> DataFrame:
    """Median and interval of baseline - value per year; ``by`` separates outputs."""
    saved = -(F.col("value") - F.col("value_base"))
    keys = [*by, *_run(measures), "year"]
    return _contrast(measures, keys, saved, [*by, "year"], level, strict, runs_bound)


def averted_total(
    measures: DataFrame, first: float, last: float, by: Sequence[str] = (), level: str = LEVEL,
    strict: bool = True, runs_bound: int | None = None,
) -> DataFrame:
    """As by year, for the sum over a closed range of years."""
    inside = measures.where(F.col("year").between(first, last))
    run = _run(measures)
    sums = inside.groupBy(*by, *run, level).agg(F.sum("value").alias("value"))
    saved = -(F.col("value") - F.col("value_base"))
    return _contrast(sums, [*by, *run], saved, list(by), level, strict, runs_bound)


def coverage_reached(summary: DataFrame, year: float) -> DataFrame:
    """Coverage found in one year, in percent, next to the target level."""
    return summary.where(F.col("year") == year).withColumn("percent", 100 * F.col("median"))
