"""Finished runs are picked up as their report files arrive."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from stratalens.sources.reports import tag_runs


def ingest_new_reports(
    spark: SparkSession, source: str, target: str, checkpoint: str, schema: StructType,
    scenario_depth: int = 2, max_files: int | None = None, name_depth: int = 1, with_file: bool = False,
) -> StreamingQuery:
    """Append every report file not seen before to the Parquet table at ``target``.

    The checkpoint remembers which files are done, so a rerun after a failure or
    after new runs reads each file once. Files of any number of runs are packed into
    tasks by size. ``with_file`` keeps each row's path, by which replaced runs are told apart.
    """
    reader = (
        spark.readStream.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
    )
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = tag_runs(reader.csv(source), scenario_depth, name_depth, with_file)
    return (
        rows.writeStream.format("parquet")
        .partitionBy("scenario")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(target)
    )
