"""Durations of use from an individual event log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalens.operators.neighbours import next_within


def use_durations(
    events: DataFrame, individual: str, time: str, name: str, start_event: str, tie_break: str,
    keep: Sequence[str] = (), hot_rows: int = 1_000_000,
) -> DataFrame:
    """Time from each start event to the next event of the same individual.

    The start event that is an individual's last event has no end and is left out, as are
    events without a time.
    """
    rows = events.select(*dict.fromkeys((individual, time, name, tie_break, *keep))).where(F.col(time).isNotNull())
    found = next_within(rows, [individual], time, tie_break, "end", hot_rows)
    return (
        found.where((F.col(name) == start_event) & F.col("end").isNotNull())
        .select(
            individual, *keep, F.col(time).alias("start"), "end",
            (F.col("end") - F.col(time)).alias("duration"),
        )
    )


def duration_histogram(
    durations: DataFrame, width: float = 30.42, low: float = 0.0, high: float = 390.0,
    facet: Sequence[str] = (),
) -> DataFrame:
    """Share of durations per bin, over all facets together.

    Bins are centred on multiples of ``width`` and include their upper edge; values
    outside ``low..high`` are removed before the share is taken. The total is a window
    over the bins, whose number follows from ``width`` and the range.
    """
    inside = durations.where(F.col("duration").between(low, high))
    bins = inside.groupBy(
        *facet, F.ceil(F.col("duration") / F.lit(width) - F.lit(0.5)).alias("bin")
    ).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return bins.select(
        *facet, "bin", (F.col("bin") * F.lit(width)).alias("centre"), "n",
        (F.col("n") / total).alias("share"),
    )


def id_uniqueness(events: DataFrame, node: str, individual: str) -> DataFrame:
    """Distinct (node, individual) pairs against distinct individuals."""
    per_id = (
        events.select(node, individual).distinct()
        .groupBy(individual).agg(F.count(F.lit(1)).alias("_nodes"))
    )
    return per_id.agg(
        F.coalesce(F.sum("_nodes"), F.lit(0)).cast("bigint").alias("n"),
        F.count(F.lit(1)).alias("n_unique"),
    )
