"""Report intervals and the calendar year they belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

YEAR_DIGITS = 3


def year_key(year: Column) -> Column:
    """Decimal years are compared after rounding, never as raw floats."""
    return F.round(year, YEAR_DIGITS)


def year_of_start(year: Column) -> Column:
    """Calendar year of an interval named by its start."""
    return F.floor(year).cast("double")


def year_of_end(year: Column) -> Column:
    """Calendar year of an interval named by its end: a whole year closes the year before."""
    return (F.ceil(year) - 1).cast("double")


def add_interval(df: DataFrame, interval: float, anchor: str) -> DataFrame:
    """``year_start``, ``year_end`` and ``year_floor`` of each report row.

    ``anchor="start"``: the report year opens the interval. ``anchor="end"``: it closes it.
    """
    year = F.col("year")
    if anchor == "start":
        start, end = year, F.round(year + F.lit(interval), 2)
    elif anchor == "end":
        start, end = year - F.lit(interval), year
    else:
        raise ValueError(f"anchor must be start or end, not {anchor!r}")
    return df.withColumns(
        {"year_start": start, "year_end": end, "year_floor": year_of_start(start)}
    )
