"""Model-shaped views over the driver's tables (see FIXTURES.md, section 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.operators.standardize import standardize_report

COUNTS = ("population", "infected", "newly_infected", "on_art", "has_prep")
# The view makes run numbers as a remainder of 8 and coverages as one of 4.
RUNS = 8
INTERVAL = 0.25
# Values of a parameter set, as many as an embedding has.
N_PARAMS = 64


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _orders_lines(spark, sf, order_columns, line_columns):
    lines = table(spark, sf, "lineitem").select("l_orderkey", *line_columns)
    orders = table(spark, sf, "orders").select("o_orderkey", *order_columns)
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def report(spark: SparkSession, sf: str, grouped: bool = True) -> DataFrame:
    """A stratified run report: counts per run, place, sex, age, status, risk and quarter.

    Not ``grouped``, a stratum may have many rows. Everything built from sums can
    start there: its own aggregation then is the first and only one over the rows.
    """
    joined = _orders_lines(
        spark, sf, ["o_custkey", "o_orderstatus", "o_orderdate"],
        ["l_suppkey", "l_partkey", "l_linestatus", "l_linenumber", "l_returnflag", "l_quantity",
         "l_discount", "l_tax"],
    )
    quarter = F.ceil(F.month("o_orderdate") / F.lit(3.0)) - 1
    flag = F.col("l_returnflag")
    line = F.col("l_linenumber")
    keys = {
        "run_num": (F.col("l_suppkey") % 8).cast("int"),
        "prep_coverage": ((F.col("l_partkey") % 4) * 30).cast("int"),
        "node_id": (F.col("o_custkey") % 6 + 1).cast("int"),
        "gender_code": F.when(F.col("l_linestatus") == "F", 0).otherwise(1),
        "age_lower": F.when(line <= 2, 0).when(line <= 5, 16).otherwise(36),
        "hiv": F.when(F.col("o_orderstatus") == "P", 1).otherwise(0),
        "risk": F.when(flag == "A", "HIGH").when(flag == "N", "MEDIUM").otherwise("LOW"),
        "circ": (F.col("l_orderkey") % 2).cast("int"),
        "year": (F.year("o_orderdate") + quarter * F.lit(0.25)).cast("double"),
    }
    quantity = F.col("l_quantity")
    # Counts are not negative, so this rounds half up without leaving doubles.
    whole = lambda x: F.floor(x + F.lit(0.5))
    counts = {
        "population": quantity,
        "infected": whole(quantity * F.col("l_discount") * 10),
        "newly_infected": whole(quantity * F.col("l_tax")),
        "on_art": whole(quantity * F.col("l_discount") * 4),
        "has_prep": F.when(F.col("l_tax") > 0.04, 1).otherwise(0),
    }
    named = [c.alias(n) for n, c in keys.items()]
    if not grouped:
        return joined.select(*named, *[c.cast("double").alias(n) for n, c in counts.items()])
    return joined.groupBy(*named).agg(*[F.sum(c).cast("double").alias(n) for n, c in counts.items()])


def standard(spark: SparkSession, sf: str, grouped: bool = False) -> DataFrame:
    """The report in measure vocabulary, one scenario per coverage."""
    rows = report(spark, sf, grouped).withColumn("scenario", F.concat(F.lit("PrEP-"), "prep_coverage"))
    return standardize_report(rows, "sweep")


def standard_by_time(spark: SparkSession, sf: str) -> DataFrame:
    """The report without the circumcision strata: one row per stratum and time."""
    keys = [
        "scenario", "run_num", "prep_coverage", "node_id", "county", "gender", "age_lower",
        "age_upper", "hiv", "risk", "year",
    ]
    return standard(spark, sf).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in COUNTS])


def observed(spark: SparkSession, sf: str) -> DataFrame:
    """The report summed over all runs in the part of the survey, in the native survey layout."""
    rows = report(spark, sf, grouped=False)
    upper = F.when(F.col("age_lower") == 0, 16).when(F.col("age_lower") == 16, 36).otherwise(100)
    keys = {
        "Year": F.col("year"),
        "County": F.concat(F.lit("County_"), F.col("node_id").cast("string")),
        "Gender": F.when(F.col("gender_code") == 0, "Male").otherwise("Female"),
        "AgeBin": F.format_string("[%d:%d)", "age_lower", upper),
    }
    sums = rows.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(
        F.sum("infected").alias("_infected"), F.sum("population").alias("pop")
    )
    return sums.select(
        *keys,
        F.try_divide(F.col("_infected"), F.col("pop")).alias("value"),
        F.col("pop").cast("int").alias("effective_count"),
        "pop",
    )


def relationships(spark: SparkSession, sf: str) -> DataFrame:
    joined = _orders_lines(
        spark, sf, ["o_custkey", "o_orderdate"],
        ["l_suppkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus"],
    )
    return joined.select(
        F.concat(F.lit("PrEP-"), (F.col("l_partkey") % 4) * 30).alias("scenario"),
        (F.col("l_suppkey") % 8).cast("int").alias("run_num"),
        (F.year("o_orderdate") + (F.month("o_orderdate") - 1) / F.lit(12.0)).alias("year"),
        (F.col("o_custkey") % 6 + 1).cast("int").alias("node_id"),
        (10 + 5 * F.col("l_linenumber")).cast("int").alias("age"),
        F.when(F.col("l_suppkey") % 2 == 0, "M").otherwise("F").alias("gender"),
        F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("was_marital"),
        F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("by_marital_partner"),
    )


def event_log(spark: SparkSession, sf: str) -> DataFrame:
    """Individual events with time in days."""
    micros = F.unix_micros(F.col("ts").cast("timestamp")).cast("double")
    return table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("individual_id"), F.col("event_type").alias("event_name"),
        (micros / F.lit(86_400_000_000.0)).alias("age"),
    )


def params(spark: SparkSession, sf: str) -> DataFrame:
    """One parameter set per embedding."""
    e = table(spark, sf, "embeddings")
    item = [F.get("embedding", F.lit(i)).cast("double") for i in range(N_PARAMS)]
    return e.select(
        F.col("vec_id").alias("parameterization_id"),
        F.when(F.col("label") % 2 == 0, "AB").otherwise("KP").alias("source"),
        *[c.alias(f"p{i}") for i, c in enumerate(item)],
        F.abs(item[0]).alias("likelihood"),
    )
