"""Outputs from sums that are kept by run: new runs are added, runs that come again replaced, nothing is read twice.

Every output closes over sums, so the sums of a run at the strata that the outputs mention are all that is needed
of its rows. A batch of runs becomes one version of the table of sums and counts from its record on: a batch that is
repeated after a failure replaces the same runs by the same sums, one that was killed before its record is never read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.operators.measures import MeasureSpec, evaluate_all
from stratalens.operators.standardize import finest_strata
from stratalens.plans.calibration import STRATA
from stratalens.sources.results import commit_version, current_results, stored, write_version
from stratalens.sources.schema import RUN_KEYS

FOLDERS = ("scenario",)


def run_sums(
    rows: DataFrame, specs: Sequence[MeasureSpec], counts: Sequence[str],
    run_keys: Sequence[str] = RUN_KEYS, strata: Sequence[str] = STRATA,
) -> DataFrame:
    """The counts that the outputs mention, summed for each run and stratum that they mention."""
    named = set().union(*[s.names() for s in specs])
    kept = [c for c in strata if c in rows.columns and c in named]
    return finest_strata(rows, [*run_keys, *kept], [c for c in counts if c in named])


def newest_rows(rows: DataFrame, run_keys: Sequence[str] = RUN_KEYS, order: Sequence[str] = ("modified", "file")) -> DataFrame:
    """The rows of each run's newest file, where one batch holds several; rows carry ``file`` and its time.

    The newest file is found by an aggregate of one small row a run, so that rows are never sorted.
    """
    newest = rows.groupBy(*run_keys).agg(F.max(F.struct(*order)).alias("_newest"))
    named = newest.select(*[F.col(k).alias(f"_{k}") for k in run_keys], "_newest")
    same = F.col("_newest").eqNullSafe(F.struct(*order))
    for k in run_keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(named, same, "left_semi")


def add_runs(
    sums: DataFrame, path: str, run_keys: Sequence[str] = RUN_KEYS, runs: DataFrame | None = None
) -> int:
    """Let the sums of a batch of whole runs take the place of what ``path`` held of these runs; other runs stay.

    ``runs`` names the runs of the batch where some may have no rows: these become empty. A batch without runs changes
    nothing but the number of records. Returns the number of the record.
    """
    rows = stored(sums, "run-sums")  # written and recorded from the same rows
    version = write_version(rows, path, FOLDERS)
    return commit_version(rows, path, version, tuple(run_keys), runs)


def kept_sums(spark: SparkSession, path: str, scenario: str | None = None, run_keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """The sums of every run as its last batch left them; a path without a record fails."""
    return current_results(spark, path, scenario=scenario, by=tuple(run_keys), folders=FOLDERS)


def kept_measures(
    spark: SparkSession, path: str, specs: Sequence[MeasureSpec], scenarios: DataFrame | None = None,
    run_keys: Sequence[str] = RUN_KEYS,
) -> DataFrame:
    """All outputs of the kept runs; with ``scenarios`` only of those, such as the finished ones of a watch.

    ``specs`` may be any outputs over columns that the sums were taken for.
    """
    sums = kept_sums(spark, path, run_keys=run_keys)
    missing = set().union(*[s.names() & set(STRATA) for s in specs]) - set(sums.columns)
    if missing:
        raise ValueError(f"the kept sums do not tell {sorted(missing)} apart")
    if scenarios is not None:
        sums = sums.join(scenarios.select("scenario"), "scenario", "left_semi")
    return evaluate_all(sums, specs, run_keys)


def sums_sink(
    path: str, specs: Sequence[MeasureSpec], counts: Sequence[str], prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
    run_keys: Sequence[str] = RUN_KEYS, strata: Sequence[str] = STRATA,
) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` over a stream of report rows with ``file`` and ``modified``.

    A batch must hold all rows of each file that it holds. ``prepare`` scales and standardises rows and keeps the run keys.
    """

    def take(batch: DataFrame, number: int) -> None:
        rows = newest_rows(batch, run_keys)
        add_runs(run_sums(prepare(rows), specs, counts, run_keys, strata), path, run_keys, rows.select(*run_keys))

    return take
