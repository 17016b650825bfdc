"""Division rules. A missing value is always NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    """``num / den``, NULL where the denominator is zero."""
    return F.try_divide(num, den)


def ratio_or_infinity(num: Column, den: Column) -> Column:
    """``num / den``, infinite for a number over zero, NULL for zero over zero."""
    endless = F.when(num > 0, F.lit(float("inf"))).when(num < 0, F.lit(float("-inf")))
    return F.when(den == 0, endless).otherwise(F.try_divide(num, den))


def ratio0(num: Column, den: Column) -> Column:
    """``num / den``, zero where the denominator is zero."""
    return F.when(den == 0, F.lit(0.0)).otherwise(F.try_divide(num, den))


def rate100(events: Column, person_years: Column) -> Column:
    """Events per 100 person-years."""
    return F.try_divide(100 * events, person_years)


def sum_strict(value: Column) -> Column:
    """A sum that is NULL as soon as one value is NULL."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))
