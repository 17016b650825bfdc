"""Column types, header names and dimension values of the input files."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Column types of the native inputs, keyed by canonical name.
STRATUM_TYPES = {
    "year": T.DoubleType(),
    "node_id": T.IntegerType(),
    "gender_code": T.IntegerType(),
    "age_lower": T.IntegerType(),
    "circ": T.IntegerType(),
    "hiv": T.IntegerType(),
    "risk": T.StringType(),
    "age": T.IntegerType(),
    "gender": T.StringType(),
    "was_marital": T.IntegerType(),
    "by_marital_partner": T.IntegerType(),
}

# Header spellings of the run report (lower case, runs of other
# characters folded to "_") and the canonical column each one becomes.
CANONICAL_NAMES = {
    "year": "year",
    "nodeid": "node_id",
    "node_id": "node_id",
    "gender": "gender_code",
    "age": "age_lower",
    "iscircumcised": "circ",
    "hashiv": "hiv",
    "ip_key_risk": "risk",
    "hasintervention_prep": "has_prep",
    "hasinterventionprep": "has_prep",
    "num_marital": "num_marital",
    "num_concordant_marital": "num_concordant_marital",
    "infectedageyears": "age",
    "infectedgender": "gender",
    "wasinmaritalrelationship": "was_marital",
    "wasinfectedbymaritalpartner": "by_marital_partner",
    "individual_id": "individual_id",
    "event_name": "event_name",
}

# Native report headers used when report files are written.
NATIVE_HEADERS = {
    "year": "Year",
    "node_id": "NodeId",
    "gender_code": "Gender",
    "age_lower": "Age",
    "circ": "IsCircumcised",
    "hiv": "HasHIV",
    "risk": "IP_Key:Risk",
    "population": "Population",
    "infected": "Infected",
    "newly_infected": "Newly Infected",
    "on_art": "On_ART",
    "has_prep": "HasIntervention(PrEP)",
}

# Node number -> county name.
COUNTIES = {1: "Homa_Bay", 2: "Kisii", 3: "Kisumu", 4: "Migori", 5: "Nyamira", 6: "Siaya"}

# Lower edges of each binning with the upper edge of each bin.
# An age outside the table gets its lower edge + 5.
AGE_UPPER = {
    "calibration": {0: 1, 1: 5, 80: 100},
    "incidence": {0: 16, 16: 18, 18: 25, 25: 36, 36: 100},
    "sweep": {0: 16, 16: 36, 36: 100},
}

# Survey labels by survey year.
SURVEY_YEARS = {"DHS": (2003.0, 2008.5), "AIS": (2007.0, 2012.0), "PHIA": (2018.0,)}

# Display order of the risk groups and of the prevention methods.
RISK_ORDER = ("Low", "Medium", "High")
METHOD_ORDER = ("Exp_90", "Const_90", "Const_100", "Exp_180", "Const_180")

OBSERVED_TYPES = {
    "Year": T.DoubleType(),
    "County": T.StringType(),
    "Gender": T.StringType(),
    "AgeBin": T.StringType(),
    "Source": T.StringType(),
}

SCENARIO_SCHEMA = T.StructType(
    [T.StructField("Scenario", T.StringType()), T.StructField("Campaign", T.StringType())]
)

CHANNEL_CONFIG_SCHEMA = (
    "map<string, struct<Year:array<double>, AgeBin:array<array<int>>, Gender:array<string>>>"
)

OVERLAY_SCHEMA = (
    "struct<Nodes:array<struct<NodeID:int, NodeName:string, IndividualProperties:"
    "array<struct<Property:string, Values:array<string>, Initial_Distribution:array<double>>>>>>"
)

# The long result every measure returns, without the run key columns.
MEASURE_COLUMNS = (
    ("year", "double"),
    ("period", "string"),
    ("county", "string"),
    ("gender", "string"),
    ("age_lower", "int"),
    ("age_upper", "int"),
    ("risk", "string"),
    ("source", "string"),
    ("measure", "string"),
    ("value", "double"),
)
DIMENSIONS = tuple(name for name, _ in MEASURE_COLUMNS if name != "value")

# A run is one report file; its scenario, number and replicate lead every group and window.
RUN_KEYS = ("scenario", "run_num", "replicate")


def run_keys_of(df: DataFrame, wanted: Sequence[str] | None = None) -> list[str]:
    """The keys asked for, by default those of ``RUN_KEYS`` that the frame has."""
    return list(wanted) if wanted is not None else [k for k in RUN_KEYS if k in df.columns]


def canonical_name(name: str) -> str:
    """One snake_case name for every spelling of a header."""
    folded = re.sub(r"[^0-9a-z]+", "_", name.lower()).strip("_")
    return CANONICAL_NAMES.get(folded, folded)


def report_field(name: str) -> T.StructField:
    """Type of one report column: strata by table, everything else is a count."""
    return T.StructField(name, STRATUM_TYPES.get(canonical_name(name), T.DoubleType()))
