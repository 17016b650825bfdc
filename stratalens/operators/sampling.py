"""Choosing parameter sets by likelihood, and numbering the chosen ones."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalens.operators.params import ID, hash_fraction

# Parts that rows are numbered in, about equal in size whatever the ids are.
PARTS = 200


def number_rows(df: DataFrame, order: str, out: str, start: int = 0) -> DataFrame:
    """Consecutive numbers in the order of a unique whole-number column.

    Rows are numbered inside ranges between quantiles of the column, and moved by the
    count of all lower ranges. Only the range counts, at most ``PARTS``, meet in one place.
    """
    cuts = df.agg(
        F.percentile_approx(order, F.array(*[F.lit(i / PARTS) for i in range(1, PARTS)])).alias("_cuts")
    ).scalar()
    ranged = df.withColumn("_cuts", cuts).withColumn(
        "_range", F.size(F.filter("_cuts", lambda c: c < F.col(order)))
    ).drop("_cuts")
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    numbered = ranged.withColumn("_rank", inside).join(offsets, "_range")
    return numbered.withColumn(
        out, (F.col("_rank") + F.col("_offset") + F.lit(start - 1)).cast("bigint")
    ).drop("_range", "_rank", "_offset")


def append_selected(
    candidates: DataFrame, runs: DataFrame, existing: DataFrame, first_id: int = 251
) -> DataFrame:
    """Selected sets renumbered from ``first_id`` under the existing ones, sorted by id."""
    chosen = candidates.join(
        runs.select(F.col("run_num").cast("bigint").alias(ID)), ID, "left_semi"
    )
    numbered = number_rows(chosen, ID, "_new", first_id).drop(ID).withColumnRenamed("_new", ID)
    return numbered.unionByName(existing, allowMissingColumns=True).orderBy(ID)


def top_likelihood(params: DataFrame, n_samples: int) -> DataFrame:
    """The most likely third of the wanted number of samples, equal ones by id."""
    return params.orderBy(F.desc("likelihood"), ID).limit(ceil(n_samples / 3))


def roulette_sample(
    params: DataFrame, n_samples: int, seed: int = 0, drop_last: bool = False
) -> DataFrame:
    """Top third plus a weighted draw without replacement from the rest.

    Each remaining set draws ``-ln(u) / p`` with ``p`` its share of the likelihood
    and ``u`` a hash of its id, and the smallest draws win, which has the same law
    as drawing one after another. ``drop_last`` leaves the least likely set out of
    the draw. Sets are numbered from 0; ``source_id`` keeps the old id. Fewer sets than
    asked for, or fewer with a likelihood to draw from, are an error. Only the ``n_samples`` rows
    asked for are ever brought together.
    """
    wanted = ceil(n_samples / 3)
    place = F.struct(F.col("likelihood"), (-F.col(ID)).alias("back"))
    cut = top_likelihood(params, n_samples).agg(F.min(place).alias("_cut")).scalar()
    marked = params.withColumn("_top", place >= cut)
    least = F.max(F.when(~F.col("_top"), F.struct((-F.col("likelihood")).alias("l"), F.col(ID).alias("id"))))
    facts = marked.agg(F.struct(
        least.alias("last"),
        F.sum(F.when(~F.col("_top"), F.col("likelihood"))).alias("total"),
        F.count_if(~F.col("_top") & (F.col("likelihood") > 0)).alias("drawable"),
        F.count_if(F.col("_top")).alias("top"),
    ).alias("_facts")).scalar()
    marked = marked.withColumn("_facts", facts)
    dropped = F.col(ID).eqNullSafe(F.col("_facts.last.id")) if drop_last else F.lit(False)
    lost = F.when(F.col("_facts.last.l") < 0, 1).otherwise(0) if drop_last else F.lit(0)
    few = (F.col("_facts.top") < wanted) | (F.col("_facts.drawable") - lost < n_samples - wanted)
    short = F.raise_error(F.lit(f"fewer than {n_samples} sets can be chosen")).cast("boolean")
    marked = marked.where(F.when(few, short).otherwise(F.lit(True)))
    chance = F.when(F.col("likelihood") > 0, F.try_divide(F.col("likelihood"), F.col("_facts.total")))
    drawn = -F.ln(hash_fraction(F.lit(seed), F.col(ID))) / chance
    both = (
        marked.withColumn("_key", F.when(F.col("_top"), -F.col("likelihood")).otherwise(drawn))
        .where(F.col("_top") | (F.col("_key").isNotNull() & ~dropped))
        .withColumn("_stage", F.when(F.col("_top"), 0).otherwise(1))
        .drop("_facts", "_top")
        .orderBy("_stage", "_key", ID)
        .limit(n_samples)
    )
    order = Window.orderBy("_stage", "_key", ID)
    return (
        both.withColumn("_new", F.row_number().over(order) - 1)
        .withColumn("selected_by", F.when(F.col("_stage") == 0, "top").otherwise("roulette"))
        .withColumnsRenamed({ID: "source_id", "_new": ID})
        .drop("_stage", "_key")
    )
