"""Run reports: one CSV per run, read as one DataFrame over a directory."""

from __future__ import annotations

import csv
import functools
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from stratalens.sources.schema import RUN_KEYS, canonical_name, report_field


class MissingSourceError(FileNotFoundError):
    """A required input has no files."""


def _token_number(name: Column, which: int) -> Column:
    token = F.get(F.split(F.regexp_replace(name, r"\.csv$", ""), "_"), F.lit(which))
    return F.regexp_replace(token, "[^0-9]", "").try_cast("int")


def run_number(name: Column) -> Column:
    """Digits of the second ``_`` token of a file name, NULL where there are none."""
    return _token_number(name, 1)


def replicate_of(name: Column) -> Column:
    """What tells files of one run number apart: the digits of the third token, or the
    whole name where it has no run number or no such digits."""
    number = F.when(run_number(name).isNotNull(), _token_number(name, 2).cast("string"))
    return F.coalesce(number, name)


def name_in(path: Column, depth: int) -> Column:
    """The part of a path at ``depth`` from the right, without a ``key=`` in front."""
    return F.regexp_replace(scenario_of(path, depth), "^[^=]*=", "")


def scenario_of(path: Column, depth: int = 2) -> Column:
    """Name of the directory ``depth`` levels from the right of a file path."""
    plus_kept = F.replace(path, F.lit("+"), F.lit("%2B"))
    return F.element_at(F.split(F.url_decode(plus_kept), "/"), -depth)


def rename_canonical(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: canonical_name(c) for c in df.columns})


def blank_nan(df: DataFrame) -> DataFrame:
    """NaN in a double column becomes NULL, the only missing value downstream."""
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles})


def report_schema(spark: SparkSession, path: str) -> T.StructType:
    """Schema from the header line alone; the data are not scanned to infer types."""
    reader = spark.read.option("header", True).option("inferSchema", False)
    header = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(path).columns
    return T.StructType([report_field(c) for c in header])


def scan_reports(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | None = None,
    scenario_depth: int = 2,
    required: bool = True,
    name_depth: int = 1,
) -> DataFrame:
    """All report files under ``path`` with canonical names, ``scenario``, ``run_num`` and ``replicate``.

    The header of every file is checked against the schema. An optional source
    that has no files gives an empty frame; a required one fails. ``name_depth`` says
    which part of the path, from the right, names the run: 1 is the file, 2 its directory.
    """
    try:
        if schema is None:
            schema = report_schema(spark, path)
        raw = (
            spark.read.schema(schema)
            .option("header", True)
            .option("enforceSchema", False)
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", "*.csv")
            .csv(path)
        )
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        if required:
            raise MissingSourceError(str(path)) from err
        keys = [
            T.StructField("scenario", T.StringType()), T.StructField("run_num", T.IntegerType()),
            T.StructField("replicate", T.StringType()),
        ]
        empty = T.StructType([*(schema.fields if schema else ()), *keys])
        return rename_canonical(spark.createDataFrame([], empty))
    return tag_runs(raw, scenario_depth, name_depth)


def file_headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, header)``: the first line of every report file, found in the tasks; files without a line are left out.

    Lines are read once and not parsed; a task passes on one row for each of its files.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
    lines = reader.text(path).where(F.col("_metadata.file_block_start") == 0)
    # Numbers rise within a task, and the beginning of a file is read by one task from its first line on.
    numbered = lines.select(F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("_n"))
    first = numbered.groupBy("file").agg(F.min_by("value", "_n").alias("header"))
    return first.withColumn("header", F.regexp_replace("header", "^\\ufeff|\\r$", ""))


def header_fields(header: str) -> T.StructType:
    """Fields of one header line. Two names that mean the same column fail: which one counts is not known."""
    names = next(csv.reader([header]))
    canonical = [canonical_name(n) for n in names]
    twice = sorted({c for c in canonical if canonical.count(c) > 1})
    if twice:
        raise ValueError(f"columns {twice} occur twice in the header {header!r}")
    return T.StructType([report_field(n) for n in names])


def scan_mixed_headers(
    spark: SparkSession, path: str | list[str], scenario_depth: int = 2, required: bool = True, name_depth: int = 1,
    with_file: bool = False,
) -> DataFrame:
    """Report files whose headers differ in order, spelling or columns: each is read by its own header, columns are bound by name.

    Files of one header are one scan, whatever their number, and the scans are united; a column that a file lacks is
    NULL there. Names of files reach the driver, as they do when Spark lists a directory. Without any file an optional
    source gives an empty frame and a required one fails, as :func:`scan_reports` does.
    """
    try:
        headers = file_headers(spark, path)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return scan_reports(spark, path, None, scenario_depth, required, name_depth)
    plain = F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B")))
    groups: dict[str, list[str]] = {}
    for row in headers.select("header", plain.alias("file")).toLocalIterator():
        groups.setdefault(row.header, []).append(row.file)
    if not groups:
        if required:
            raise MissingSourceError(str(path))
        return scan_reports(spark, f"{path}/none", None, scenario_depth, False, name_depth)
    scans = []
    for header in sorted(groups):
        files = [re.sub(r"([\\*?\[\]{}])", r"\\\1", f) for f in sorted(groups[header])]
        raw = spark.read.schema(header_fields(header)).option("header", True).option("enforceSchema", False).csv(files)
        scans.append(tag_runs(raw, scenario_depth, name_depth, with_file))
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)


def tag_runs(raw: DataFrame, scenario_depth: int = 2, name_depth: int = 1, with_file: bool = False) -> DataFrame:
    """Canonical columns of a file-backed frame plus the run keys from its paths, on demand also the path as ``file``."""
    path = F.col("_metadata.file_path")
    name = name_in(path, name_depth)
    tagged = raw.select(
        "*",
        *([path.alias("file")] if with_file else []),
        name_in(path, scenario_depth).alias("scenario"),
        run_number(name).alias("run_num"),
        replicate_of(name).alias("replicate"),
    )
    return blank_nan(rename_canonical(tagged))


def scale_counts(
    df: DataFrame,
    first: str,
    last: str | None = None,
    scale_factor: float = 1.0,
    pop_adjust: float | None = None,
    keep: Iterable[str] = RUN_KEYS,
) -> DataFrame:
    """Counts of a closed column range brought to full population size.

    The range follows the physical column order, from ``first`` to ``last`` (or
    to the end); the columns in ``keep`` are never scaled.
    """
    start = df.columns.index(first)
    end = len(df.columns) if last is None else df.columns.index(last) + 1
    chosen = [c for c in df.columns[start:end] if c not in set(keep)]

    def scaled(name: str) -> Column:
        count = F.col(name) if pop_adjust is None else F.col(name) * F.lit(pop_adjust)
        return count / F.lit(scale_factor)

    return df.withColumns({c: scaled(c) for c in chosen})
