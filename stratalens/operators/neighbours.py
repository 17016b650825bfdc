"""The previous or next value within an ordered group, with hot groups split."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Slices of a hot group, between quantiles of its distinct values.
SLICES = 64


def lag_within(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str) -> DataFrame:
    """Previous value of a group whose size is bounded, such as the times of a stratum."""
    return df.withColumn(out, F.lag(value).over(Window.partitionBy(*keys).orderBy(order)))


def same(left: str, right: str, names: Sequence[str]) -> Column:
    """Equality of columns, also where both are missing."""
    return reduce(lambda c, n: c & F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}")), names, F.lit(True))


def hot_groups(df: DataFrame, keys: Sequence[str], order: str, hot_rows: int) -> DataFrame:
    """Groups of at least ``hot_rows`` rows and where to cut them: quantiles of ``order``."""
    probs = F.array(*[F.lit(i / SLICES) for i in range(1, SLICES)])
    sizes = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), F.percentile_approx(order, probs).alias("_cuts")
    )
    return sizes.where(F.col("_rows") >= hot_rows).drop("_rows")


def next_within(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    tie_break: str,
    out: str,
    hot_rows: int = 1_000_000,
) -> DataFrame:
    """Next value of ``order`` within each group; ``tie_break`` tells equal values apart.

    Rows at one value follow each other, so only the last of them looks further: the
    window runs over the distinct values of a group, and a burst at one instant is one
    of them. A group of many values is cut between quantiles of these; the last value of a
    slice takes the first of the slice that follows. A missing key is a group of its own.
    """
    keys = list(keys)
    values = df.groupBy(*keys, order).agg(F.max(tie_break).alias("_last"))
    hot = hot_groups(values, keys, order, hot_rows)
    sliced = values.alias("v").join(hot.alias("h"), same("v", "h", keys), "left").select(
        *[F.col(f"v.{k}").alias(k) for k in (*keys, order, "_last")],
        F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(f"v.{order}"))), F.lit(0)).alias("_slice"),
        F.col("_cuts").isNotNull().alias("_hot"),
    )
    heads = sliced.where("_hot").groupBy(*keys, "_slice").agg(F.min(order).alias("_head")).withColumn(
        "_head", F.lead("_head").over(Window.partitionBy(*keys).orderBy("_slice"))
    )
    local = Window.partitionBy(*keys, "_slice").orderBy(order)
    following = (
        sliced.withColumn("_next", F.lead(order).over(local)).alias("a")
        .join(heads.alias("b"), same("a", "b", [*keys, "_slice"]), "left")
        .select(*[F.col(f"a.{k}").alias(k) for k in (*keys, order, "_last")], F.coalesce("_next", "_head").alias("_next"))
    )
    return (
        df.alias("d").join(following.alias("f"), same("d", "f", [*keys, order]))
        .select(
            *[F.col(f"d.{c}").alias(c) for c in df.columns],
            F.when(F.col(f"d.{tie_break}") < F.col("_last"), F.col(f"d.{order}")).otherwise(F.col("_next")).alias(out),
        )
    )
