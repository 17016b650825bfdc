"""Parameter sets: reshaping, box statistics and the mapping to model inputs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.functions.recode import strip_parameter_prefix
from stratalens.operators.quantiles import exact_quantiles
from stratalens.sources.results import stored
from stratalens.sources.schema import COUNTIES, OVERLAY_SCHEMA

ID = "parameterization_id"
BOOKKEEPING = ("run_number", "iteration_number", "sim_id", "likelihood")

# Names of the mapped parameters and of their model inputs.
ORDERED_PAIRS = (
    ("ProbExtraTransitoryMaleLow", "ProbExtraTransitoryMaleMedium"),
    ("ProbExtraTransitoryFemaleLow", "ProbExtraTransitoryFemaleMedium"),
)
LOG_INFECTIVITY = "LOG Base Infectivity"
INFECTIVITY = "Base_Infectivity"
LINK_RANGE = ("PreARTLinkMinimum", "PreARTLinkMaximum")
LINK_INPUT = "Actual_IndividualIntervention_Config__KP_PreART_Link"
SEX_MULTIPLIERS = ("MaleToFemaleYoung", "MaleToFemaleOld")
SEX_INPUT = "Male_To_Female_Relative_Infectivity_Multipliers"
ASSORTIVITY = "RiskAssortivity"
ASSORTIVITY_INPUT = "Weighting_Matrix_RowMale_ColumnFemale__KP_RiskAssortivity"
LOW_RISK_SUFFIX = "PropLowRisk"
RISK_INPUT = "Initial_Distribution__KP_Risk_"
MEDIUM_INPUT = "Actual_IndividualIntervention_Config__KP_Medium_Risk_"
FANNED_OUT = {
    "Risk Reduction Fraction": "Ramp_Max",
    "Risk Ramp Rate": "Ramp_Rate",
    "Risk Ramp MidYear": "Ramp_MidYear",
}


def tag_source(sets: Mapping[str, DataFrame]) -> DataFrame:
    """Parameter tables of several calibrations under one another with a ``source``."""
    parts = [df.withColumn("source", F.lit(name)) for name, df in sets.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def unpivot_params(
    df: DataFrame, ids: Sequence[str] = (ID,), drop: Sequence[str] = BOOKKEEPING
) -> DataFrame:
    """Wide sets to ``(ids, parameter, value)``."""
    kept = [c for c in df.columns if c not in {*ids, *drop}]
    values = [F.col(f"`{c}`").cast("double").alias(c) for c in kept]
    return df.select(*ids, *values).unpivot(list(ids), kept, "parameter", "value")


def box_statistics(long: DataFrame, keys: Sequence[str] = ("parameter", "source")) -> DataFrame:
    """Quartiles, extremes and whiskers (the last values within 1.5 box lengths).

    There is one group per parameter and source; groups grow with the number of
    sets and are never gathered.
    """
    boxes = stored(exact_quantiles(
        long, keys, "value", (0.0, 0.25, 0.5, 0.75, 1.0), ("min", "q1", "median", "q3", "max")
    ), "boxes")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)
    whiskers = long.join(boxes, list(keys)).groupBy(*keys).agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
    )
    return boxes.join(whiskers, list(keys))


def constrain_sample(df: DataFrame, pairs: Sequence[tuple[str, str]] = ORDERED_PAIRS) -> DataFrame:
    """The low-risk value of each pair is at most the medium-risk value."""
    present = [(low, mid) for low, mid in pairs if low in df.columns and mid in df.columns]
    return df.withColumns({low: F.least(F.col(low), F.col(mid)) for low, mid in present})


def ordered_range(df: DataFrame, names: tuple[str, str], low: str, high: str) -> DataFrame:
    """A pair given in any order as a minimum and a maximum."""
    a, b = (F.col(f"`{n}`") for n in names)
    return df.withColumns({low: F.least(a, b), high: F.greatest(a, b)}).drop(*names)


def assortivity_matrix(v: Column) -> Column:
    zero = F.lit(0.0)
    return F.array(
        F.array(v, 1 - v, zero), F.array(1 - v, v, v), F.array(zero, v, 1 - v)
    )


def _special_entries(columns: set[str], counties: Sequence[str]) -> tuple[list[Column], set[str]]:
    """Model inputs with a rule of their own, and the parameters those rules use up.

    An entry is ``(target, rows)`` with ``rows`` an array: one value for a scalar
    input, several for a vector, the rows one after another for a matrix.
    """
    entries, used = [], set()

    def add(target: str, *values: Column, when: Column | None = None):
        entry = F.struct(
            F.lit(target).alias("target"), F.array(*[v.cast("double") for v in values]).alias("rows")
        )
        entries.append(entry if when is None else F.when(when, entry))

    def col(name: str) -> Column:
        return F.col(f"`{name}`")

    if LOG_INFECTIVITY in columns:
        add(INFECTIVITY, F.exp(col(LOG_INFECTIVITY)))
        used.add(LOG_INFECTIVITY)
    if columns.issuperset(LINK_RANGE):
        low, high = map(col, LINK_RANGE)
        add(f"{LINK_INPUT}.Ramp_Min", F.least(low, high))
        add(f"{LINK_INPUT}.Ramp_Max", F.greatest(low, high))
        used.update(LINK_RANGE)
    if columns.issuperset(SEX_MULTIPLIERS):
        young, old = map(col, SEX_MULTIPLIERS)
        add(SEX_INPUT, young, young, old)
        used.update(SEX_MULTIPLIERS)
    for county in counties:
        share = f"{county}{LOW_RISK_SUFFIX}"
        if share in columns:
            add(f"{RISK_INPUT}{county}", col(share), 1 - col(share), F.lit(0.0))
            used.add(share)
        for name, suffix in FANNED_OUT.items():
            if name in columns:
                add(f"{MEDIUM_INPUT}{county}.{suffix}", col(name), when=col(name).isNotNull() & ~F.isnan(col(name).cast("double")))
    used.update(columns & set(FANNED_OUT))
    if ASSORTIVITY in columns:
        flat = F.flatten(assortivity_matrix(col(ASSORTIVITY)))
        entries.append(F.struct(F.lit(ASSORTIVITY_INPUT).alias("target"), flat.alias("rows")))
        used.add(ASSORTIVITY)
    return entries, used


def map_to_inputs(
    df: DataFrame, renames: Mapping[str, str | Sequence[str]],
    counties: Sequence[str] = tuple(COUNTIES.values()), special: bool = True,
) -> DataFrame:
    """Model inputs as ``(parameterization_id, target, position, value)``.

    ``renames`` sends a parameter to one input or to several. Vectors and matrices
    take one row per position.
    """
    entries, used = _special_entries(set(df.columns) - {ID}, counties if special else ())
    for name, targets in renames.items():
        if name in df.columns and name not in used:
            for target in [targets] if isinstance(targets, str) else targets:
                value = F.array(F.col(f"`{name}`").cast("double"))
                entries.append(F.struct(F.lit(target).alias("target"), value.alias("rows")))
    exploded = df.select(ID, F.explode(F.array(*entries)).alias("_e")).where("_e IS NOT NULL")
    return exploded.select(
        ID,
        strip_parameter_prefix(F.col("_e.target")).alias("target"),
        F.posexplode("_e.rows").alias("position", "value"),
    )


def unmapped_parameters(
    long: DataFrame, renames: Mapping[str, object], counties: Sequence[str] = tuple(COUNTIES.values())
) -> DataFrame:
    """Parameter names no rule uses; a complete mapping leaves this empty.

    ``long`` has one row per set and parameter.
    """
    names = long.select("parameter").distinct()
    known = {
        LOG_INFECTIVITY, *LINK_RANGE, *SEX_MULTIPLIERS, *FANNED_OUT, ASSORTIVITY, *renames,
        *[f"{c}{LOW_RISK_SUFFIX}" for c in counties],
    }
    rules = long.sparkSession.createDataFrame([(n,) for n in sorted(known)], "parameter string")
    return names.join(F.broadcast(rules), "parameter", "left_anti")


def config_entries(documents: DataFrame, json: str = "config") -> DataFrame:
    """``(key, value)`` of flat configuration documents; a value is JSON text, so numbers, text and arrays stay apart."""
    parsed = F.parse_json(F.col(json))
    pairs = documents.select(parsed.alias("_v")).lateralJoin(
        documents.sparkSession.tvf.variant_explode(F.col("_v").outer())
    )
    return pairs.select("key", F.to_json("value").alias("value"))


def override_config(base: DataFrame, overrides: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """Each set's configuration: its own value where it has one, else the base value.

    ``base`` has ``(key, value)``, ``overrides`` has ``(parameterization_id, key,
    value)`` with one row a key at most, ``sets`` the ids of all sets (by default those
    that override something). Two overrides of one key fail. An override replaces the base value also by NULL. A key
    that only a set has is added, as an update would. Values are of any one type.
    """
    ids = (overrides if sets is None else sets).select(ID).distinct().withColumn("_document", F.lit(0))
    given = ids.join(base.withColumn("_document", F.lit(0)), "_document").select(
        ID, "key", "value", F.lit(False).alias("_own")
    )
    both = given.unionByName(overrides.select(ID, "key", "value", F.lit(True).alias("_own")))
    found = both.groupBy(ID, "key").agg(
        F.max_by(F.struct("value"), "_own")["value"].alias("value"), F.count_if("_own").alias("_given")
    )
    twice = F.raise_error(F.concat(F.lit("two overrides of "), "key")).cast("boolean")
    return found.where(F.when(F.col("_given") > 1, twice).otherwise(F.lit(True))).drop("_given")


def hash_fraction(*parts: Column) -> Column:
    """A repeatable number in (0, 1) from the first 52 bits of a digest of the parts."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(1 << 52))


def run_seed(id_: Column, seed: int) -> Column:
    """A repeatable run seed from 0 to 65535."""
    digest = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), id_.cast("string")))
    return F.conv(F.substring(digest, 1, 4), 16, 10).cast("int")


def explode_overlay(df: DataFrame, json: str = "overlay") -> DataFrame:
    """Node x property x value x share from nested overlay documents."""
    nodes = df.select(F.explode(F.from_json(json, OVERLAY_SCHEMA)["Nodes"]).alias("n"))
    properties = nodes.select("n.NodeID", "n.NodeName", F.explode("n.IndividualProperties").alias("p"))
    return properties.select(
        F.col("NodeID").alias("node_id"),
        F.col("NodeName").alias("node_name"),
        F.col("p.Property").alias("property"),
        F.inline(F.arrays_zip("p.Values", "p.Initial_Distribution")).alias("value", "share"),
    )
