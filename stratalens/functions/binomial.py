"""Exact binomial confidence bounds, evaluated once per distinct (successes, trials)."""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TINY = 1e-300
_log_gamma = np.vectorize(lgamma, otypes=[float])


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function by the modified Lentz method."""
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
    h = d.copy()
    m = 0
    active = np.ones(x.shape, dtype=bool)
    while active.any():
        m += 1
        before = h.copy()
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + term * d
            d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1.0 + term / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            h = np.where(active, h * c * d, h)
        active &= np.abs(h - before) > 1e-15 * np.abs(h)
    return h


def log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Logarithm of the beta function."""
    return _log_gamma(a) + _log_gamma(b) - _log_gamma(a + b)


def incomplete_beta(
    a: np.ndarray, b: np.ndarray, x: np.ndarray, log_whole: np.ndarray | None = None
) -> np.ndarray:
    """Regularised incomplete beta function for 0 < x < 1; ``log_whole`` is ``log_beta(a, b)`` where it is known."""
    log_whole = log_beta(a, b) if log_whole is None else log_whole
    front = np.exp(a * np.log(x) + b * np.log1p(-x) - log_whole)
    direct = x < (a + 1.0) / (a + b + 2.0)
    aa, bb, xx = np.where(direct, a, b), np.where(direct, b, a), np.where(direct, x, 1.0 - x)
    part = front * _beta_fraction(aa, bb, xx) / aa
    return np.where(direct, part, 1.0 - part)


def beta_quantile(p: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The x at which the incomplete beta function reaches ``p``, by bisection."""
    low, high = np.zeros_like(a), np.ones_like(a)
    log_whole = log_beta(a, b)
    for _ in range(60):
        mid = (low + high) / 2.0
        below = incomplete_beta(a, b, mid, log_whole) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2.0


def exact_bounds(x: np.ndarray, n: np.ndarray, level: float = 0.95):
    """Clopper-Pearson bounds; both are NaN without trials and outside 0 <= x <= n."""
    tail = (1.0 - level) / 2.0
    x, n = np.asarray(x, float), np.asarray(n, float)
    lower, upper = np.full(x.shape, np.nan), np.full(x.shape, np.nan)
    some = (n > 0) & (x >= 0) & (x <= n * (1 + 1e-9))
    lower[some], upper[some] = 0.0, 1.0
    has_low, has_high = some & (x > 0), some & (x < n)
    lower[has_low] = beta_quantile(tail, x[has_low], n[has_low] - x[has_low] + 1)
    upper[has_high] = beta_quantile(1 - tail, x[has_high] + 1, n[has_high] - x[has_high])
    return lower, upper


def binomial_bounds(pairs: DataFrame, level: float = 0.95) -> DataFrame:
    """``(successes, trials)`` rows with ``exact_lower`` and ``exact_upper``.

    Duplicate pairs are removed by a distributed distinct before Python sees them;
    batches stream through the tasks, so no group is ever gathered.
    """

    def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            low, high = exact_bounds(batch["successes"].values, batch["trials"].values, level)
            yield batch.assign(exact_lower=low, exact_upper=high)

    distinct = pairs.select(
        F.col("successes").cast("double"), F.col("trials").cast("double")
    ).where("successes IS NOT NULL AND trials IS NOT NULL").distinct()
    schema = "successes double, trials double, exact_lower double, exact_upper double"
    found = distinct.mapInPandas(bounds, schema)
    nan_out = {
        c: F.when(~F.isnan(c), F.col(c)) for c in ("exact_lower", "exact_upper")
    }
    return found.withColumns(nan_out)
