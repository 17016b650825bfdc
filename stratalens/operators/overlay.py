"""Model bands next to survey points, one table per chart."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalens.functions.intervals import year_key
from stratalens.functions.recode import age_label, survey_source


@dataclass(frozen=True)
class OverlaySpec:
    """One comparison: which model rows, which survey rows, what splits the panels."""

    name: str
    output: str
    model_where: str | None = None
    observed: str | None = None
    observed_where: str | None = None
    facet: tuple[str, ...] = ()
    label: str | None = None


def overlays(last: float = 2020, adult: int = 15, old: int = 50, single: float = 2009) -> list[OverlaySpec]:
    """The comparisons of the calibration report."""
    until = f"year <= {last}"
    whole = "age_lower = 0 AND age_upper = 100"
    detail = f"NOT ({whole})"
    province = "county = 'All' AND gender = 'Both'"
    by_sex = "county = 'All' AND gender <> 'Both'"
    county_sex = "county <> 'All' AND gender <> 'Both'"
    adults = f"age_lower = {adult} AND age_upper = {old}"
    age, sex = ("age_lower",), ("gender",)
    return [
        OverlaySpec("pop", "pop", until, "population", f"{province} AND {whole}"),
        OverlaySpec("pop_age", "pop_age", until, "population", f"{province} AND {detail}", ("age",), "Census"),
        OverlaySpec("pop_county", "pop_county", until, "population",
                    f"county <> 'All' AND gender = 'Both' AND {whole}", ("county",)),
        OverlaySpec("pop_county_age", "pop_county_age", until, "population",
                    "county <> 'All' AND gender = 'Both' AND year <> 2019", ("county", "age_lower")),
        OverlaySpec("pop_age_single", "pop_age", f"year = {single}", "population",
                    f"{province} AND {detail}", ("age",), "Census"),
        OverlaySpec("art", "art", until, "art", province),
        OverlaySpec("art_gender_age", "art_gender_age", until, "art", by_sex, ("age_lower", "gender")),
        OverlaySpec("art_gender_adult", "art_gender_age", f"{until} AND age_lower = {adult}", "art",
                    f"{by_sex} AND age_lower = {adult}", ("age_lower", "gender")),
        OverlaySpec("art_county_gender_age", "art_county_gender_age", until, "art", county_sex,
                    ("county", "age_lower")),
        OverlaySpec("art_prev", "art_prev", until, "art_share", "gender = 'Both'"),
        OverlaySpec("art_prev_gender", "art_prev_gender", until, "art_share", "gender <> 'Both'", sex, "PHIA"),
        OverlaySpec("art_prev_gender_all_years", "art_prev_gender", None, "art_share", "gender <> 'Both'", sex, "PHIA"),
        OverlaySpec("art_prev_gender_adults", "art_prev_gender_adults", None, "art_share", "gender <> 'Both'", sex, "PHIA"),
        OverlaySpec("art_prev_gender_county", "art_prev_gender_county", None, None, None, ("county", "gender")),
        OverlaySpec("prev", "prev", until, "prevalence", province, (), "survey"),
        OverlaySpec("prev_gender", "prev_gender", until, "prevalence", f"{by_sex} AND {adults}", sex, "survey"),
        OverlaySpec("prev_gender_age", "prev_gender_age", f"{until} AND age_upper <= {old}", "prevalence",
                    f"{by_sex} AND NOT ({adults}) AND age_upper <= {old}", ("gender", "age"), "survey"),
        OverlaySpec("prev_county_gender", "prev_county_gender", until, "prevalence",
                    f"{county_sex} AND {adults}", ("gender", "county")),
        OverlaySpec("circ", "circ", until, "circumcision", "county = 'All' AND year <> 2003"),
        OverlaySpec("circ_recent", "circ", f"year >= 2000 AND {until}", "circumcision",
                    "county = 'All' AND year <> 2003"),
        OverlaySpec("circ_all_years", "circ", None, "circumcision", "county = 'All' AND year <> 2003"),
        OverlaySpec("circ_age_young", "circ_age", f"age_lower >= {adult} AND age_upper <= 25", None, None, age),
        OverlaySpec("circ_age", "circ_age", None, None, None, age),
        OverlaySpec("circ_county", "circ_county", None, "circumcision", "county <> 'All'", ("county",)),
    ]


def overlay(
    summary: DataFrame, observed: Mapping[str, DataFrame], specs: Sequence[OverlaySpec],
    keys: Sequence[str] = (),
) -> DataFrame:
    """Rows of both origins in one layout: ``origin`` Model or Observed, ``value`` the
    median or the survey value, ``source`` the survey label, ``facet`` the panel.

    ``summary`` has an ``output`` column; ``observed`` maps survey names to tables.
    Each row is tagged with all comparisons it belongs to, so every input is read
    once however many comparisons there are.
    """
    model = summary.withColumn("value", F.col("median"))
    parts = [
        _layout(
            model, "Model", keys,
            [(s, f"output = '{s.output}'", s.model_where, F.lit(None).cast("string")) for s in specs],
        )
    ]
    for name, rows in observed.items():
        chosen = [s for s in specs if s.observed == name]
        if chosen:
            parts.append(
                _layout(rows, "Observed", keys, [(s, None, s.observed_where, _source(s)) for s in chosen])
            )
    return reduce(DataFrame.unionByName, parts)


def _source(spec: OverlaySpec) -> Column:
    if spec.label == "survey":
        return survey_source(F.col("year"))
    return F.lit(spec.label).cast("string")


def _facet(spec: OverlaySpec) -> Column:
    shown = [
        age_label(F.col("age_lower"), F.col("age_upper")) if f == "age" else F.col(f).cast("string")
        for f in spec.facet
    ]
    return F.concat_ws(" / ", *shown) if shown else F.lit("")


def _layout(df: DataFrame, origin: str, keys: Sequence[str], tags: list[tuple]) -> DataFrame:
    def tag(spec, first, second, source):
        entry = F.struct(
            F.lit(spec.name).alias("overlay"), source.alias("source"), _facet(spec).alias("facet")
        )
        where = " AND ".join(f"({w})" for w in (first, second) if w)
        return F.when(F.expr(where), entry) if where else entry

    def column(name: str, type_: str) -> Column:
        return (F.col(name) if name in df.columns else F.lit(None)).cast(type_).alias(name)

    rows = df.withColumn("_t", F.explode(F.array(*[tag(*t) for t in tags]))).where("_t IS NOT NULL")
    return rows.select(
        *[column(k, "string") for k in keys],
        F.col("_t.overlay").alias("overlay"),
        F.lit(origin).alias("origin"),
        F.col("_t.source").alias("source"),
        F.col("_t.facet").alias("facet"),
        column("year", "double"), "county", "gender", column("age_lower", "int"), column("age_upper", "int"),
        *[column(c, "double") for c in ("value", "lower", "upper")],
    )


def validation(
    summary: DataFrame, observed: DataFrame,
    on: Sequence[str] = ("county", "gender", "age_lower", "age_upper"), by_year: bool = True,
) -> DataFrame:
    """Modelled interval and survey value side by side, with a flag for "inside".

    Rows without a partner stay, their flag is NULL.
    """
    left = summary.select(
        *on, "year", F.col("median").alias("model"), F.col("lower").alias("model_lower"),
        F.col("upper").alias("model_upper"),
    ).withColumn("_year", year_key(F.col("year")) if by_year else F.lit(0))
    right = observed.select(*on, "year", F.col("value").alias("observed")).withColumn(
        "_year", year_key(F.col("year")) if by_year else F.lit(0)
    )
    keys = [*on, "_year"]
    joined = left.withColumnRenamed("year", "model_year").join(
        right.withColumnRenamed("year", "observed_year"), keys, "full_outer"
    )
    return joined.withColumn(
        "inside", F.col("observed").between(F.col("model_lower"), F.col("model_upper"))
    ).drop("_year")


def age_order(df: DataFrame) -> DataFrame:
    """Display label of each age bin and its place in the order of lower bounds.

    The window runs over the distinct bins only, one row per bin of the model.
    """
    bins = df.select("age_lower", "age_upper").distinct()
    rank = F.dense_rank().over(Window.orderBy("age_lower"))
    return bins.select(
        "age_lower", "age_upper", age_label(F.col("age_lower"), F.col("age_upper")).alias("age"),
        rank.alias("age_order"),
    )

