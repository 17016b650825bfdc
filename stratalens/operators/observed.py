"""Survey tables: standard columns, totals, weighted means and bounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.functions.binomial import binomial_bounds
from stratalens.functions.ratios import ratio
from stratalens.functions.recode import age_bin_bound, gender_from_survey, gender_two_way

# Totals over the detail rows: which dimensions stay, and whether the total leaves
# out the year that only counts adults.
MARGINS = (
    (("year", "county", "age_lower", "age_upper"), False),
    (("year", "county"), True),
    (("year", "age_lower", "age_upper"), True),
    (("year",), False),
)
DIMS = ("year", "county", "gender", "age_lower", "age_upper")


def standardize_observed(
    df: DataFrame, value: str, measure: str, drop: Sequence[str] = (), two_way: bool = False,
    recode_gender: bool = True,
) -> DataFrame:
    """Lower-case names, integer age bounds, model sex labels, bounds ``lower``/``upper``."""
    names = {
        "Year": "year", "County": "county", "Gender": "gender", value: "value",
        "lb": "lower", "ub": "upper",
    }
    gender = F.col("gender")
    if recode_gender:
        gender = gender_two_way(gender) if two_way else gender_from_survey(gender)
    return (
        df.drop(*drop)
        .withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})
        .withColumns(
            {
                "age_lower": age_bin_bound(F.col("AgeBin"), 1),
                "age_upper": age_bin_bound(F.col("AgeBin"), 2),
                "gender": gender,
                "measure": F.lit(measure),
            }
        )
        .drop("AgeBin")
    )


def add_marginals(detail: DataFrame, adults_only_year: float) -> DataFrame:
    """The detail rows and their totals over sex, ages and counties.

    All four levels are grouping sets of one aggregate over pre-summed rows; the
    set is told by ``grouping_id``, so a key that is really NULL keeps its row.
    """
    sums = detail.groupBy(*DIMS).agg(F.sum("value").alias("value"))
    sets = [[F.col(k) for k in keys] for keys, _ in MARGINS]
    gid = F.grouping_id("year", "county", "age_lower", "age_upper")
    totals = sums.withColumn("_adult", F.col("year") == adults_only_year)
    totals = totals.groupingSets(
        sets, F.col("year"), F.col("county"), F.col("age_lower"), F.col("age_upper")
    ).agg(F.sum("value").alias("value"), F.max("_adult").alias("_adult"), gid.alias("_gid"))
    skipped = [_gid(keys) for keys, skips in MARGINS if skips]
    no_county, no_age = F.col("_gid").bitwiseAND(4) != 0, F.col("_gid").bitwiseAND(1) != 0
    totals = totals.where(
        ~(F.col("_gid").isin(*skipped) & F.coalesce(F.col("_adult"), F.lit(False)))
    ).select(
        "year",
        F.when(no_county, F.lit("All")).otherwise(F.col("county")).alias("county"),
        F.lit("Both").alias("gender"),
        F.when(no_age, F.lit(0)).otherwise(F.col("age_lower")).alias("age_lower"),
        F.when(no_age, F.lit(100)).otherwise(F.col("age_upper")).alias("age_upper"),
        "value",
        F.lit("Population").alias("measure"),
    )
    return detail.unionByName(totals, allowMissingColumns=True)


def _gid(keys: Sequence[str]) -> int:
    """``grouping_id(year, county, age_lower, age_upper)`` of one grouping set."""
    order = ("year", "county", "age_lower", "age_upper")
    return sum(1 << (3 - i) for i, name in enumerate(order) if name not in keys)


def add_county_total(df: DataFrame, keys: Sequence[str] = DIMS + ("measure",)) -> DataFrame:
    """Totals over the counties, leaving out rows that are totals already."""
    by = [k for k in keys if k != "county"]
    total = (
        df.where("county <> 'All'").groupBy(*by).agg(F.sum("value").alias("value"))
        .withColumn("county", F.lit("All"))
    )
    return df.unionByName(total, allowMissingColumns=True)


def add_exact_bounds(df: DataFrame, level: float = 0.95) -> DataFrame:
    """Exact binomial bounds of ``value`` out of ``effective_count``; without trials the
    given ``lb`` and ``ub`` stand."""
    rows = df.withColumns(
        {
            "successes": F.col("value") * F.col("effective_count"),
            "trials": F.col("effective_count").cast("double"),
        }
    )
    found = binomial_bounds(rows.select("successes", "trials"), level)
    joined = rows.join(found, ["successes", "trials"], "left")
    given = F.col("effective_count") == 0
    return joined.withColumns(
        {
            "lower": F.when(given, F.col("lb")).otherwise(F.col("exact_lower")),
            "upper": F.when(given, F.col("ub")).otherwise(F.col("exact_upper")),
        }
    ).drop("successes", "trials", "exact_lower", "exact_upper", "effective_count", "lb", "ub")


def with_province_row(
    table: DataFrame, weights: DataFrame, year: float, ages: tuple[int, int], measure: str
) -> DataFrame:
    """A survey table and, appended, its population-weighted province row of one year."""
    row = weighted_total(weights, table.where(F.col("year") == year)).select(
        F.lit(float(year)).alias("year"), F.lit("All").alias("county"), F.lit("Both").alias("gender"),
        F.lit(ages[0]).alias("age_lower"), F.lit(ages[1]).alias("age_upper"), F.lit(measure).alias("measure"),
        "value", "lower", "upper",
    )
    return table.unionByName(row, allowMissingColumns=True)


def weighted_total(
    weights: DataFrame, values: DataFrame, on: Sequence[str] = ("county",),
    measures: Sequence[str] = ("value", "lower", "upper"),
) -> DataFrame:
    """Population-weighted means over all places, as one row.

    The weight of a place counts once per matching value row, and a place without a value makes the mean missing.
    """
    joined = weights.join(values, list(on), "left")
    complete = F.count(F.lit(1))
    return joined.agg(
        *[
            F.when(
                F.count(m) == complete, ratio(F.sum(F.col("pop") * F.col(m)), F.sum("pop"))
            ).alias(m)
            for m in measures
        ]
    )


def split_coverage_by_sex(
    combined: DataFrame, prevalence: DataFrame, coverage: DataFrame
) -> DataFrame:
    """Coverage of men and of women from a coverage of both.

    ``prevalence`` and ``coverage`` are the reference rows, one per sex; their four
    values are one aggregate.
    """
    both = prevalence.select("gender", "value", F.lit("p").alias("of")).unionByName(
        coverage.select("gender", "value", F.lit("c").alias("of"))
    )

    def value(of: str, sex: str) -> Column:
        return F.max(F.when((F.col("of") == of) & (F.col("gender") == sex), F.col("value")))

    row = both.agg(F.struct(
        value("p", "Men").alias("pm"), value("p", "Women").alias("pw"),
        value("c", "Men").alias("cm"), value("c", "Women").alias("cw"),
    ).alias("r")).scalar()
    relative = ratio(F.col("_r.cw"), F.col("_r.cm"))
    multiplier = ratio(F.col("_r.pm") + F.col("_r.pw") * relative, F.col("_r.pm") + F.col("_r.pw"))
    return combined.withColumn("_r", row).withColumn("_m", multiplier).select(
        "year",
        ratio(F.col("value"), F.col("_m")).alias("art_prev_men"),
        (F.col("value") * F.col("_m")).alias("art_prev_women"),
    )
