"""Named result sets: one long table, partitioned by scenario and output name."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all executors can reach.

    Where the session names none, a session on one machine gets a temporary folder; a cluster fails.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        root = tempfile.mkdtemp(prefix="stratalens-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def save_results(df: DataFrame, path: str, by: tuple[str, ...] = ("scenario", "output")) -> str:
    """Write a named result set.

    Rows are first brought together by output, so that tasks do not each leave a
    small file in every directory; outputs too large for one writer are split and
    small ones merged by size at run time.
    """
    df = df.hint("rebalance", *by)
    df.write.mode("errorifexists").partitionBy(*by).parquet(path)
    return path


def load_results(
    spark: SparkSession, path: str, output: str | None = None, scenario: str | None = None
) -> DataFrame:
    """Read a named result set; both filters prune partitions."""
    df = spark.read.parquet(path)
    if output is not None:
        df = df.where(F.col("output") == output)
    if scenario is not None:
        df = df.where(F.col("scenario") == scenario)
    return df


def write_version(df: DataFrame, path: str, by: tuple[str, ...] = ("scenario", "output")) -> str:
    """Write rows as a version of their own below ``path``; nobody reads it before :func:`commit_version`."""
    version = uuid.uuid4().hex
    df.hint("rebalance", *by).write.partitionBy(*by).parquet(f"{path}/data/version={version}")
    return version


def _commits(spark: SparkSession, path: str, by: tuple[str, ...]) -> DataFrame:
    schema = ", ".join([*(f"`{c}` string" for c in by), "version string", "fields string", "commit long"])
    try:
        return spark.read.schema(schema).parquet(f"{path}/commits")
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def commit_version(
    df: DataFrame, path: str, version: str, by: tuple[str, ...] = ("scenario", "output"), parts: DataFrame | None = None
) -> int:
    """Let the partitions of a written version take the place of those before, all at once.

    ``parts`` names the partitions, by default those that have rows; one without rows becomes empty.
    The record is one file that appears whole or not at all. A number that another writer has taken, or left behind
    when it was killed, is passed over; of two records with one number the larger version counts.
    """
    spark = df.sparkSession
    last = _commits(spark, path, by).agg(F.max("commit")).first()[0]
    number = 0 if last is None else last + 1
    parts = (df if parts is None else parts).select(*[F.col(c).cast("string") for c in by]).distinct()
    record = parts.withColumns({"version": F.lit(version), "fields": F.lit(df.schema.json())})
    while True:
        try:
            record.coalesce(1).write.mode("errorifexists").parquet(f"{path}/commits/commit={number}")
            return number
        except AnalysisException as err:
            if err.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            number += 1


def replace_results(df: DataFrame, path: str, by: tuple[str, ...] = ("scenario", "output")) -> str:
    """Write a named result set so that it replaces what an earlier one left in the same scenarios and outputs.

    Other scenarios and outputs stay. Readers see the state before or after, also if the writer is killed: rows without a
    record are never read.
    """
    rows = stored(df, "replacing")  # written and recorded from the same rows
    commit_version(rows, path, write_version(rows, path, by), by)
    return path


def current_results(
    spark: SparkSession, path: str, output: str | None = None, scenario: str | None = None, by: tuple[str, ...] = ("scenario", "output"),
    folders: tuple[str, ...] | None = None,
) -> DataFrame:
    """The result set as the last record of every scenario and output left it; both filters prune partitions.

    Versions may differ in columns: one that a version lacks is NULL there, one that changed its type fails. A path without
    a record has no result set and fails. ``folders`` are the columns that versions were partitioned by, where these are not ``by``.
    """
    folders = by if folders is None else folders
    commits = _commits(spark, path, by)
    newest = F.max_by(F.struct("version", "fields"), F.struct("commit", "version"))
    live = commits.groupBy(*by).agg(newest.alias("_n")).select(*[F.col(c).alias(f"_{c}") for c in by], "_n.version", "_n.fields")
    fields: dict[str, T.StructField] = {}
    for row in live.select("fields").distinct().collect():  # a few layouts
        for f in T.StructType.fromJson(json.loads(row.fields)).fields:
            known = fields.setdefault(f.name, T.StructField(f.name, f.dataType))
            if known.dataType != f.dataType:
                raise ValueError(f"column {f.name} is {known.dataType.simpleString()} in one version and {f.dataType.simpleString()} in another")
    if not fields:
        raise FileNotFoundError(f"no result set at {path}")
    schema = T.StructType([T.StructField(n, T.StringType()) if n in folders else f for n, f in fields.items()])
    names = [f"`{n}`" for n in fields]
    rows = spark.read.schema(schema.add("version", "string")).parquet(f"{path}/data").withColumnRenamed("version", "_version")
    for name, wanted in (("output", output), ("scenario", scenario)):
        if wanted is not None:
            rows, live = rows.where(F.col(name) == wanted), live.where(F.col(f"_{name}") == wanted)
    same = [F.col("_version") == F.col("version"), *(F.col(c).cast("string").eqNullSafe(F.col(f"_{c}")) for c in by)]
    kept = rows.join(live, same, "left_semi").select(*names)
    return kept.withColumns({c: F.col(c).cast(fields[c].dataType) for c in folders})


def stored(df: DataFrame, label: str) -> DataFrame:
    """The frame written to the shared folder and read back: later steps that use it
    several times do not compute it again, also after executors are lost."""
    spark = df.sparkSession
    path = shared_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def save_csv(df: DataFrame, path: str) -> str:
    df.write.mode("errorifexists").option("header", True).csv(path)
    return path
