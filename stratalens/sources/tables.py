"""Smaller inputs: survey tables, scenario tables, parameter sets, event logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalens.functions.recode import list_or_null
from stratalens.sources.reports import blank_nan, rename_canonical
from stratalens.sources.schema import OBSERVED_TYPES, SCENARIO_SCHEMA


class MissingCampaignError(ValueError):
    """A scenario table has no ``Campaign`` column."""


def _header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).option("inferSchema", False).csv(path).columns


def _typed_csv(spark: SparkSession, path: str, types: dict, default=T.DoubleType()) -> DataFrame:
    schema = T.StructType([T.StructField(c, types.get(c, default)) for c in _header(spark, path)])
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False)
    return blank_nan(reader.csv(path))


def read_observed(spark: SparkSession, path: str) -> DataFrame:
    """A survey table: place, sex, age bin, and any number of value columns."""
    return _typed_csv(spark, path, OBSERVED_TYPES)


def read_scenarios(
    spark: SparkSession, path: str | None, lists: Sequence[str] = ()
) -> DataFrame:
    """Scenario rows; without a table there is one unnamed scenario. The columns in
    ``lists`` hold text such as ``[1,2,3]`` and become arrays."""
    if path is None:
        return spark.createDataFrame([(None, None)], SCENARIO_SCHEMA)
    header = _header(spark, path)
    if "Campaign" not in header:
        raise MissingCampaignError(f"column Campaign is missing from {path}")
    rows = _typed_csv(spark, path, {}, T.StringType())
    return rows.withColumns({c: list_or_null(F.col(c)) for c in lists})


def read_parameter_sets(spark: SparkSession, path: str) -> DataFrame:
    """One row per sample; ids are whole numbers, every parameter is a double."""
    ids = {c: T.IntegerType() for c in ("parameterization_id", "run_number", "iteration_number")}
    return _typed_csv(spark, path, {**ids, "sim_id": T.StringType()})


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Individual events with ``age`` in days."""
    types = {
        "Node_ID": T.IntegerType(),
        "Individual_ID": T.LongType(),
        "Event_Name": T.StringType(),
    }
    return rename_canonical(_typed_csv(spark, path, types)).withColumnRenamed("age_lower", "age")


def read_channel_config(spark: SparkSession, path: str) -> DataFrame:
    """The channel file as one row with one JSON string column ``config``."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("config"))
