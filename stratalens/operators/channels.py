"""Report channels: one value per year, place, sex and age bin of a configured grid."""

from __future__ import annotations

import re
from collections.abc import Collection, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.functions.intervals import year_key, year_of_end
from stratalens.functions.ratios import ratio0
from stratalens.functions.recode import (
    age_bin_text,
    gender_code_from_letter,
    gender_code_from_name,
    gender_name_from_code,
)
from stratalens.sources.schema import CHANNEL_CONFIG_SCHEMA, run_keys_of

ALL_NODES = 0
BOTH = 2
RESULT_COLUMNS = ("Year", "Node", "Gender", "AgeBin", "Result")
RESULT_SCHEMA = "Year double, Node int, Gender string, AgeBin string, Result double"


class UnknownSourceError(ValueError):
    """A report source that no channel reads."""


class UnsupportedChannelError(ValueError):
    """A configured channel without a definition."""


class EmptyCellError(ValueError):
    """A grid cell without data in a channel that must be complete."""


@dataclass(frozen=True)
class ChannelSpec:
    """How one channel is computed.

    ``years``: ``"whole"`` adds every whole year of the data to the configured
    ones, ``"half"`` the half-years from 2000.5, ``"configured"`` adds none.
    ``by_node``: ``"each"``, ``"all"`` or ``"both"``.
    """

    name: str
    source: str
    counts: tuple[str, ...]
    num: str
    den: str | None = None
    where: str | None = None
    years: str = "configured"
    by_node: str = "both"
    complete: bool = True
    positive: str | None = None

    def result(self) -> Column:
        if self.den is None:
            return F.expr(self.num)
        if self.positive is None:
            return ratio0(F.expr(self.num), F.expr(self.den))
        return F.when(
            F.expr(self.positive) > 0, F.try_divide(F.expr(self.num), F.expr(self.den))
        ).otherwise(F.lit(0.0))


REPORT = "ReportHIVByAgeAndGender"
RELATIONSHIPS = "ReportRelationshipsAtInfection"
_MARITAL = ("num_marital", "num_concordant_marital")
_DISCORDANT = "num_marital - num_concordant_marital"

CHANNELS = {
    c.name: c
    for c in (
        ChannelSpec("Prevalence", REPORT, ("infected", "population"), "infected", "population", years="whole"),
        ChannelSpec("Population", REPORT, ("population",), "population", years="whole"),
        ChannelSpec("OnART", REPORT, ("on_art",), "on_art", years="half"),
        ChannelSpec("ARTCoverage", REPORT, ("on_art", "infected"), "on_art", "infected", years="whole"),
        ChannelSpec(
            "Incidence", REPORT,
            ("newly_infected_annualized", "population", "infected", "newly_infected"),
            "newly_infected_annualized", "population - infected - newly_infected",
            years="whole_but_last", positive="population",
        ),
        ChannelSpec(
            "PrevDiscordMalePositive", REPORT, _MARITAL, _DISCORDANT, "num_marital",
            where="hiv = 1", by_node="each",
        ),
        ChannelSpec(
            "PrevDiscordFemalePositive", REPORT, _MARITAL, _DISCORDANT, "num_marital",
            where="hiv = 0",
        ),
        ChannelSpec(
            "ExternalStableDiscordantConversionRate", RELATIONSHIPS,
            ("n_external_infections", "n_internal_infections"),
            "n_external_infections", "n_external_infections + n_internal_infections",
            complete=False,
        ),
    )
}


def channel_cells(config: str | DataFrame) -> Column:
    """The channel file as ``map<channel, struct<Year, AgeBin, Gender>>``, from its text or
    from the one row that ``read_channel_config`` gives."""
    text = F.lit(config) if isinstance(config, str) else config.select("config").scalar()
    return F.from_json(text, CHANNEL_CONFIG_SCHEMA)


def unsupported_channels(configured: DataFrame, known: Sequence[str] = tuple(CHANNELS)) -> DataFrame:
    """Configured channel names that have no definition."""
    return configured.select("channel").distinct().where(~F.col("channel").isin(*known))


def check_channels(names: Sequence[str], sources: Collection[str] = (REPORT, RELATIONSHIPS)) -> None:
    """Fail on a name that no channel of the given sources has."""
    known = {c.name for c in CHANNELS.values() if c.source in sources}
    missing = sorted(set(names) - known)
    if missing:
        raise UnsupportedChannelError(f"no definition for channel {missing[0]}")


def channels_of(source: str) -> list[ChannelSpec]:
    found = [c for c in CHANNELS.values() if c.source == source]
    if not found:
        raise UnknownSourceError(f"unknown report source {source}")
    return found


def _years(spec: ChannelSpec, configured: Column) -> Column:
    """Report years of a channel, from the data range and the configured years."""
    first, last = F.ceil("_first").cast("int"), F.floor("_last").cast("int")

    def run_of_years(start: Column, stop: Column) -> Column:
        whole = F.when(start <= stop, F.sequence(start, stop))
        return F.coalesce(whole, F.array().cast("array<int>")).cast("array<double>")

    if spec.years == "whole":
        own = run_of_years(first, last)
    elif spec.years == "whole_but_last":
        own = run_of_years(first, last - 1)
    elif spec.years == "half":
        own = F.transform(run_of_years(F.lit(2000), last - 1), lambda y: y + F.lit(0.5))
    elif spec.years == "configured":
        own = F.array().cast("array<double>")
    else:
        raise ValueError(f"{spec.name}: unknown years {spec.years!r}")
    return F.array_union(own, configured)


def channel_grid(
    df: DataFrame, specs: Sequence[ChannelSpec], config: str, run_keys: Sequence[str] | None = None,
    nodes: DataFrame | None = None,
) -> DataFrame:
    """Every cell the channels have to report, per run.

    Years and places come from the run's own data by one small aggregate, bins and
    sexes from the configuration. ``nodes`` names another frame to take the places
    from. A run's places are the nodes of the model, a fixed short list.
    """
    run_keys = run_keys_of(df, run_keys)
    places = F.collect_set("node_id").alias("_nodes")
    bounds = [F.min("year").alias("_first"), F.max("year").alias("_last")]
    if nodes is None:
        seen = df.groupBy(*run_keys).agg(*bounds, places)
    else:
        seen = df.groupBy(*run_keys).agg(*bounds).join(nodes.groupBy(*run_keys).agg(places), run_keys)
    seen = seen.withColumn("_config", channel_cells(config))

    def entry(spec: ChannelSpec) -> Column:
        own = F.try_element_at("_config", F.lit(spec.name))
        every = F.array(F.lit(ALL_NODES))
        listed = {
            "each": F.col("_nodes"), "all": every, "both": F.concat("_nodes", every)
        }[spec.by_node]
        cells = F.struct(
            F.lit(spec.name).alias("channel"),
            _years(spec, own["Year"]).alias("years"),
            own["AgeBin"].alias("bins"),
            own["Gender"].alias("names"),
            listed.alias("nodes"),
        )
        return F.when(own.isNotNull(), cells)

    per_channel = seen.select(
        *run_keys, F.explode(F.array_compact(F.array(*[entry(s) for s in specs]))).alias("_e")
    )
    exploded = (
        per_channel.withColumn("year", F.explode("_e.years"))
        .withColumn("_bin", F.explode("_e.bins"))
        .withColumn("_name", F.explode("_e.names"))
        .withColumn("node_id", F.explode("_e.nodes"))
    )
    return exploded.select(
        *run_keys,
        F.col("_e.channel").alias("channel"),
        "year",
        gender_code_from_name(F.col("_name")).alias("gender_code"),
        F.get("_bin", F.lit(0)).alias("age_lower"),
        F.get("_bin", F.lit(1)).alias("age_upper"),
        "node_id",
    )


def annualise_infections(
    df: DataFrame, run_keys: Sequence[str] | None = None,
    strata: Sequence[str] = ("node_id", "gender_code", "age_lower", "circ", "risk"),
) -> DataFrame:
    """Rows at mid-year with the new infections of their whole calendar year.

    Only rows dated exactly half past a year are kept, and they take that whole year.
    """
    dated = df.withColumn("year_in", year_of_end(F.col("year")))
    keys = [*run_keys_of(df, run_keys), *strata]
    yearly = dated.groupBy(*keys, "year_in").agg(
        F.sum("newly_infected").alias("newly_infected_annualized")
    )
    middle = dated.where(year_key(F.col("year")) == year_key(F.col("year_in") + 0.5))
    return middle.join(yearly, [*keys, "year_in"]).drop("year").withColumnRenamed("year_in", "year")


def infection_sources(df: DataFrame, run_keys: Sequence[str] | None = None) -> DataFrame:
    """Infections in stable relationships per stratum, by whether the partner was the source.

    Both counts come from one conditional aggregate. A stratum with neither kind is absent.
    """
    stable = df.where("was_marital = 1 AND by_marital_partner IN (0, 1)")
    return (
        stable.groupBy(
            *run_keys_of(df, run_keys),
            year_of_end(F.col("year")).alias("year"),
            "node_id",
            F.col("age").alias("age_lower"),
            gender_code_from_letter(F.col("gender")).alias("gender_code"),
        )
        .agg(
            F.count_if(F.col("by_marital_partner") == 0).cast("double").alias("n_external_infections"),
            F.count_if(F.col("by_marital_partner") == 1).cast("double").alias("n_internal_infections"),
        )
    )


def computable(df: DataFrame, specs: Sequence[ChannelSpec]) -> list[ChannelSpec]:
    """The channels whose count columns are all there; the others are skipped."""
    return [s for s in specs if set(s.counts) <= set(df.columns)]


def _by_channel(specs: Sequence[ChannelSpec], build, otherwise: Column) -> Column:
    chain = otherwise
    for spec in specs:
        made = build(spec)
        if made is not None:
            chain = F.when(F.col("channel") == spec.name, made).otherwise(chain)
    return chain


CELL = ("channel", "year", "node_id", "gender_code", "age_lower", "age_upper")


def channel_sums(
    df: DataFrame, specs: Sequence[ChannelSpec], grid: DataFrame, run_keys: Sequence[str] | None = None
) -> DataFrame:
    """Sums of the rows in each grid cell, with the number of rows found.

    Rows are first summed to strata. A stratum counts for its own place and for all
    places, for its own sex and for both, so it is met with the grid of all channels on
    run, year, place and sex; only age and the channel's own condition decide within that match.
    """
    run_keys = run_keys_of(df, run_keys)
    counts = sorted({c for s in specs for c in s.counts})
    tested = set().union(*[set(re.findall(r"[A-Za-z_]\w*", s.where or "")) for s in specs])
    extra = [c for c in df.columns if c in tested]
    keys = [*run_keys, "_year"]
    strata = (
        df.withColumn("_year", year_key(F.col("year")))
        .groupBy(*keys, "node_id", "gender_code", "age_lower", *extra)
        .agg(*[F.sum(c).alias(c) for c in counts], F.count(F.lit(1)).alias("_n"))
        .withColumnRenamed("age_lower", "_age")
        .withColumn("node_id", F.explode(F.array_distinct(F.array("node_id", F.lit(ALL_NODES)))))
        .withColumn("gender_code", F.explode(F.array_distinct(F.array("gender_code", F.lit(BOTH)))))
    )
    cells = grid.withColumn("_year", year_key(F.col("year")))
    selected = _by_channel(specs, lambda s: F.expr(s.where) if s.where else None, F.lit(True))
    inside = (
        (F.col("_age") >= F.col("age_lower"))
        & (F.col("_age") < F.col("age_upper"))
        & selected
    )
    met = [*keys, "node_id", "gender_code"]
    same = reduce(lambda c, k: c & (F.col(f"d.{k}") == F.col(f"g.{k}")), met, F.lit(True))
    return (
        strata.alias("d").join(cells.alias("g"), same & inside)
        .groupBy(*[F.col(f"g.{k}").alias(k) for k in (*run_keys, *CELL)])
        .agg(*[F.sum(c).alias(c) for c in counts], F.sum("_n").alias("_n"))
    )


def channel_results(
    df: DataFrame, specs: Sequence[ChannelSpec], config: str, run_keys: Sequence[str] | None = None,
    grid: DataFrame | None = None, strict: bool = True,
) -> DataFrame:
    """``channel, Year, Node, Gender, AgeBin, Result`` per run, all channels in one pass.

    A channel that need not be complete reports zero for an empty cell. One that
    must be complete fails on it, or leaves it out if not ``strict``. A channel whose
    count columns are absent is left out.
    """
    run_keys = run_keys_of(df, run_keys)
    specs = computable(df, specs)
    if not specs:
        keys = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in run_keys)
        return df.sparkSession.createDataFrame([], f"{keys}, channel string, {RESULT_SCHEMA}")
    if grid is None:
        grid = channel_grid(df, specs, config, run_keys)
    sums = channel_sums(df, specs, grid, run_keys)
    if strict or not all(s.complete for s in specs):
        complete = F.col("channel").isin([s.name for s in specs if s.complete])
        sums = grid.join(sums, [*run_keys, *CELL], "left")
        empty = F.col("_n").isNull()
        if strict:
            message = F.format_string("channel %s is empty for year %s", "channel", "year")
            failed = F.raise_error(message).cast("boolean")
            sums = sums.where(F.when(complete & empty, failed).otherwise(F.lit(True)))
        else:
            sums = sums.where(~(complete & empty))
        counts = sorted({c for s in specs for c in s.counts})
        sums = sums.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in counts})
    result = _by_channel(specs, lambda s: s.result().cast("double"), F.lit(None).cast("double"))
    return sums.select(
        *run_keys,
        "channel",
        F.col("year").alias("Year"),
        F.col("node_id").alias("Node"),
        gender_name_from_code(F.col("gender_code")).alias("Gender"),
        age_bin_text(F.col("age_lower"), F.col("age_upper")).alias("AgeBin"),
        result.alias("Result"),
    )


def empty_cells(
    df: DataFrame, specs: Sequence[ChannelSpec], config: str, run_keys: Sequence[str] | None = None
) -> DataFrame:
    """Grid cells without a single row, for the channels that must be complete."""
    run_keys = run_keys_of(df, run_keys)
    checked = [s for s in computable(df, specs) if s.complete]
    grid = channel_grid(df, checked, config, run_keys)
    found = channel_sums(df, checked, grid, run_keys)
    cell = [*run_keys, *CELL]
    return grid.select(*cell).join(found, cell, "left_anti")
