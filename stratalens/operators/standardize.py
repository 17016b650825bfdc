"""Report frames in the vocabulary of the measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.functions.recode import age_upper, county_name, gender_from_code, risk_label
from stratalens.sources.schema import MEASURE_COLUMNS


def standardize_report(df: DataFrame, binning: str, label_risk: bool = False) -> DataFrame:
    """County and sex labels and the upper age bound added to a canonical report."""
    out = df.withColumns(
        {
            "county": county_name(F.col("node_id")),
            "gender": gender_from_code(F.col("gender_code")),
            "age_upper": age_upper(F.col("age_lower"), binning),
        }
    ).drop("gender_code")
    return out.withColumn("risk", risk_label(F.col("risk"))) if label_risk else out


def finest_strata(df: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """Counts summed to the finest stratum that any later measure groups by.

    Every numerator and denominator is a sum, so measures taken from this table
    equal those taken from the rows.
    """
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])


def as_measure_rows(df: DataFrame, run_keys: list[str], extra: list[str] = ()) -> DataFrame:
    """Cast and order to the fixed long layout."""
    return df.select(
        *run_keys, *extra, *[F.col(n).cast(t).alias(n) for n, t in MEASURE_COLUMNS]
    )
