"""Exact quantiles (linear interpolation between order statistics) per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalens.sources.results import stored

# Groups known to stay below this many values fit one aggregation buffer.
SMALL_GROUP = 100_000
# Rank error of the guide is at most n / ACCURACY.
ACCURACY = 10_000
# Groups that an aggregation holds whole where no bound is stated; the sketch is too coarse to help there.
WHOLE = 2 * ACCURACY


def _same(left: str, right: str, keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(f"{left}.{key}").eqNullSafe(F.col(f"{right}.{key}"))
    return condition


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    names: Sequence[str],
    mean: str | None = None,
    group_bound: int | None = None,
) -> DataFrame:
    """Quantiles of the non-null values of each group, optionally with their mean.

    ``group_bound`` states how many values a group can hold at most; a group with
    more fails. Up to ``SMALL_GROUP`` one aggregation does the work. Larger or unknown
    groups take ``_ranked_quantiles``, which never brings a whole group into one task.
    """
    if group_bound is None or group_bound > SMALL_GROUP:
        return _ranked_quantiles(df, keys, value, probs, names, mean)
    averages = [F.avg(value).alias(mean)] if mean else []
    wrong = F.raise_error(F.lit(f"a group has more than {group_bound} values")).cast("array<double>")
    found = df.groupBy(*keys).agg(
        *averages,
        F.when(F.count(value) > group_bound, wrong)
        .otherwise(F.percentile(value, F.array(*[F.lit(p) for p in probs]))).alias("_q"),
    )
    return found.select(
        *keys,
        *([mean] if mean else []),
        *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(names)],
    )


def _ranked_quantiles(df, keys, value, probs, names, mean):
    """Selection by the size of the group, which a first pass counts.

    Groups of at most ``WHOLE`` values are one aggregation. A second pass sketches each of the others:
    for every probability a value that is certainly not above and one that is
    certainly not below the wanted order statistics. In the third pass rows below that span are only
    counted, rows above it are dropped, and rows inside it (about ``4 n / ACCURACY``) are ranked.
    Equal values are merged into one counted row before they are shuffled.

    Sizes and spans are one small row a group. They are stored, so the optimizer knows their size and sends them to the tasks
    if it is small; otherwise the join shuffles.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v"))
    averages = [F.avg("_v").alias(mean)] if mean else []
    sizes = stored(rows.groupBy(*keys).agg(*averages, F.count("_v").alias("_n")), "group-sizes")
    kept = [*keys, *([mean] if mean else [])]
    most = sizes.agg(F.max("_n")).first()[0] or 0
    if most <= WHOLE:
        found = _whole_groups(rows, keys, probs, names)
    else:
        few = sizes.where(F.col("_n") <= WHOLE).select(*keys)
        many = sizes.where(F.col("_n") > WHOLE).select(*keys, "_n")
        found = _whole_groups(_rows_of(rows, few, keys, "left_semi"), keys, probs, names).unionByName(
            _spanned_groups(_rows_of(rows, many, keys, "inner"), keys, probs, names)
        )
    return (
        sizes.select(*kept).alias("g")
        .join(found.alias("w"), _same("g", "w", keys), "left")
        .select(*[F.col(f"g.{k}").alias(k) for k in kept], *[F.col(f"w.{n}") for n in names])
    )


def _rows_of(rows: DataFrame, groups: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """The rows with a value of some groups; the groups' file is small enough to be sent to the tasks or is not."""
    joined = rows.where("_v IS NOT NULL").alias("r").join(groups.alias("s"), _same("r", "s", keys), how)
    more = [f"s.{c}" for c in groups.columns if c not in keys and how == "inner"]
    return joined.select(*[F.col(f"r.{k}").alias(k) for k in keys], "r._v", *more)


def _whole_groups(rows, keys, probs, names):
    """Groups that fit one aggregation buffer: their counted values are merged before the shuffle."""
    found = rows.groupBy(*keys).agg(F.percentile("_v", F.array(*[F.lit(p) for p in probs])).alias("_q"))
    return found.select(*keys, *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(names)])


def _spanned_groups(rows, keys, probs, names):
    """Groups of any size, by bracketing each wanted rank; rows carry the size ``_n`` of their group."""
    slack = 2.0 / ACCURACY
    ends = [max(p - slack, 0.0) for p in probs] + [min(p + slack, 1.0) for p in probs]
    guide = rows.groupBy(*keys).agg(F.percentile_approx("_v", F.array(*[F.lit(e) for e in ends]), ACCURACY).alias("_ends"))
    spans = stored(guide.select(
        *keys,
        F.transform(F.sequence(F.lit(0), F.lit(len(probs) - 1)), lambda i: F.struct(
            i.alias("i"), F.get("_ends", i).alias("lo"), F.get("_ends", i + len(probs)).alias("hi"),
        )).alias("_spans"),
    ), "group-spans")
    tagged = (
        rows.alias("r").join(spans.alias("s"), _same("r", "s", keys))
        .select(*[F.col(f"r.{k}").alias(k) for k in keys], "_v", "_n", F.inline("_spans"))
        .where("_v <= hi")
        .withColumn("_v", F.when(F.col("_v") >= F.col("lo"), F.col("_v")))
    )
    counted = tagged.groupBy(*keys, "_n", "i", "_v").agg(F.count(F.lit(1)).alias("_c"))
    ordered = Window.partitionBy(*keys, "i").orderBy(F.col("_v").asc_nulls_first())
    upto = F.sum("_c").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    prob = F.get(F.array(*[F.lit(float(p)) for p in probs]), F.col("i"))
    ranked = counted.withColumn("_last", upto).withColumn("_pos", prob * (F.col("_n") - 1))

    def statistic(rank: Column) -> Column:
        inside = (F.col("_last") - F.col("_c") <= rank) & (rank < F.col("_last"))
        return F.max(F.when(inside, F.col("_v")))

    pairs = ranked.groupBy(*keys, "i").agg(
        F.max("_pos").alias("_pos"),
        statistic(F.floor("_pos")).alias("_a"),
        statistic(F.ceil("_pos")).alias("_b"),
    )
    below, above = F.floor("_pos"), F.ceil("_pos")
    exact = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(
        (above - F.col("_pos")) * F.col("_a") + (F.col("_pos") - below) * F.col("_b")
    )
    checked = F.when(
        F.col("_a").isNull() | F.col("_b").isNull(),
        F.raise_error(F.lit("quantile outside its span")).cast("double"),
    ).otherwise(exact)
    return pairs.groupBy(*keys).agg(
        *[F.max(F.when(F.col("i") == k, checked)).alias(n) for k, n in enumerate(names)]
    )
