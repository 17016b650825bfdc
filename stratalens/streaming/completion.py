"""Which scenarios are finished: run files as they arrive, held against the runs that the manifest asks for.

Streaming state per run knows its newest file, so a file that comes again replaces the one before and an older one
that comes late does not. Every batch writes its arrivals, then the scenarios that it completed, each below
its batch number: a batch that is repeated after a failure writes the same folders again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.utils import AnalysisException

from stratalens.sources.reports import name_in, replicate_of, run_number
from stratalens.sources.schema import RUN_KEYS

ARRIVALS = "scenario string, run_num int, replicate string, version int, file string, modified timestamp"
_FILE = "path string, modificationTime timestamp, length long, content binary"
FINISHED = "scenario string, n_expected long, n_arrived long"


def arriving_files(
    spark: SparkSession, source: str, scenario_depth: int = 2, name_depth: int = 1, max_files: int | None = None
) -> DataFrame:
    """A stream of ``(scenario, run_num, replicate, file, modified)``, one row for each report file; no file is read."""
    reader = spark.readStream.format("binaryFile").schema(_FILE).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    path = F.col("_metadata.file_path")
    name = name_in(path, name_depth)
    return reader.load(source).select(
        name_in(path, scenario_depth).alias("scenario"), run_number(name).alias("run_num"), replicate_of(name).alias("replicate"),
        path.alias("file"), F.col("_metadata.file_modification_time").alias("modified"),
    )


def newest_files(files: DataFrame) -> DataFrame:
    """A stream of the files that become the newest of their run, with ``version`` 1 for the first.

    Of files with one time of modification the one with the larger path is newer. The state is one small row a run.
    """
    def versions(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, held = state.get if state.exists else (0, "")
        out = []
        for frame in frames:
            for row in frame.itertuples(index=False):
                mark = f"{row.modified.value:020d} {row.file}"
                if mark > held:
                    held = mark
                    out.append((row.file, row.modified))
        if out:
            out.sort(key=lambda x: (x[1], x[0]))
            version += 1
            state.update((version, held))
            file, modified = out[-1]
            run = None if key[1] is None or pd.isna(key[1]) else key[1]
            frame = pd.DataFrame([(key[0], run, key[2], version, file, modified)], columns=[*RUN_KEYS, "version", "file", "modified"])
            yield frame.astype({"run_num": "Int32"})

    return files.groupBy(*RUN_KEYS).applyInPandasWithState(
        versions, ARRIVALS, "version int, held string", "append", GroupStateTimeout.NoTimeout
    )


def _read(spark: SparkSession, target: str, table: str, schema: str) -> DataFrame:
    """All batches of a table below ``target``, with ``batch``; none before the first."""
    schema = f"{schema}, batch long"
    try:
        return spark.read.schema(schema).parquet(f"{target}/{table}")
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def arrivals(spark: SparkSession, target: str) -> DataFrame:
    """Every arrival that the watch has noted, with its ``batch``."""
    return _read(spark, target, "arrivals", ARRIVALS)


def finished(spark: SparkSession, target: str) -> DataFrame:
    """Scenarios in the batch that completed them; each is there once."""
    return _read(spark, target, "finished", FINISHED)


def current_files(noted: DataFrame) -> DataFrame:
    """``(scenario, run_num, replicate, file, version)``: the newest file of every run that arrived."""
    newest = F.max_by(F.struct("file", "version"), "version")
    return noted.groupBy(*RUN_KEYS).agg(newest.alias("_n")).select(*RUN_KEYS, "_n.file", "_n.version")


def run_status(expected: DataFrame, noted: DataFrame) -> DataFrame:
    """Every run that is expected or arrived: ``expected``, ``version`` (null if missing). Runs are matched by grouping, nulls too."""
    both = expected.select(*RUN_KEYS, F.lit(True).alias("_expected"), F.lit(None).cast("int").alias("version")).unionByName(
        noted.select(*RUN_KEYS, F.lit(False).alias("_expected"), "version")
    )
    return both.groupBy(*RUN_KEYS).agg(F.bool_or("_expected").alias("expected"), F.max("version").alias("version"))


def missing_runs(expected: DataFrame, noted: DataFrame) -> DataFrame:
    """The runs of the manifest that have not arrived."""
    return run_status(expected, noted).where("expected AND version IS NULL").select(*RUN_KEYS)


def scenario_status(expected: DataFrame, noted: DataFrame) -> DataFrame:
    """``(scenario, n_expected, n_arrived, n_replaced, n_unexpected, complete)``; a scenario no run is expected of is never complete."""
    wanted, here = F.col("expected"), F.col("version").isNotNull()
    counts = run_status(expected, noted).groupBy("scenario").agg(
        F.count_if(wanted).alias("n_expected"), F.count_if(wanted & here).alias("n_arrived"),
        F.count_if(F.col("version") > 1).alias("n_replaced"), F.count_if(~wanted).alias("n_unexpected"),
    )
    return counts.withColumn("complete", (F.col("n_expected") > 0) & (F.col("n_expected") == F.col("n_arrived")))


def settle(events: DataFrame, batch: int, expected: DataFrame, target: str) -> None:
    """Note the arrivals of one batch, and the scenarios that are complete with it and were not before."""
    spark = events.sparkSession
    events.write.mode("overwrite").parquet(f"{target}/arrivals/batch={batch}")
    noted = arrivals(spark, target).where(F.col("batch") <= batch)
    touched = noted.where(F.col("batch") == batch).select("scenario").distinct()
    before = finished(spark, target).where(F.col("batch") < batch).select("scenario")
    # Only scenarios that something arrived for can have become complete.
    mine = lambda df: df.join(touched, "scenario", "left_semi").join(before, "scenario", "left_anti")
    done = scenario_status(mine(expected), mine(noted)).where("complete")
    done.select("scenario", "n_expected", "n_arrived").write.mode("overwrite").parquet(f"{target}/finished/batch={batch}")


def watch_runs(
    spark: SparkSession, source: str, expected: DataFrame, target: str, checkpoint: str,
    scenario_depth: int = 2, name_depth: int = 1, max_files: int | None = None,
) -> StreamingQuery:
    """Take up all files that arrived since the last start, then stop; ``target`` holds arrivals and finished scenarios.

    ``expected`` has one row for each run of the manifest; repeated rows count once. A run that is not in it
    is noted and holds nothing up. A scenario that was finished stays so when a file of it is replaced later.
    """
    wanted = expected.select(*RUN_KEYS).distinct()
    events = newest_files(arriving_files(spark, source, scenario_depth, name_depth, max_files))
    return (
        events.writeStream.foreachBatch(lambda df, batch: settle(df, batch, wanted, target))
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def finished_rows(rows: DataFrame, spark: SparkSession, target: str) -> DataFrame:
    """Of report rows with their ``file`` those of finished scenarios, each run by its newest file alone."""
    files = current_files(arrivals(spark, target)).join(finished(spark, target).select("scenario"), "scenario", "left_semi")
    return rows.join(files.select("file"), "file", "left_semi").drop("file")
