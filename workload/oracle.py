"""SQL twins of the registered queries, written against the same tables."""

from __future__ import annotations

# --- shared views ------------------------------------------------------------

REPORT = """report AS (
SELECT CAST(l.l_suppkey % 8 AS INT) AS run_num,
       CAST((l.l_partkey % 4) * 30 AS INT) AS prep_coverage,
       CAST(o.o_custkey % 6 + 1 AS INT) AS node_id,
       CASE WHEN l.l_linestatus = 'F' THEN 0 ELSE 1 END AS gender_code,
       CASE WHEN l.l_linenumber <= 2 THEN 0 WHEN l.l_linenumber <= 5 THEN 16 ELSE 36 END AS age_lower,
       CASE WHEN o.o_orderstatus = 'P' THEN 1 ELSE 0 END AS hiv,
       CASE l.l_returnflag WHEN 'A' THEN 'HIGH' WHEN 'N' THEN 'MEDIUM' ELSE 'LOW' END AS risk,
       CAST(l.l_orderkey % 2 AS INT) AS circ,
       CAST(year(o.o_orderdate) + (CAST(ceil(month(o.o_orderdate) / 3.0) AS INT) - 1) * 0.25 AS DOUBLE) AS year,
       CAST(SUM(l.l_quantity) AS DOUBLE) AS population,
       CAST(SUM(ROUND(l.l_quantity * l.l_discount * 10)) AS DOUBLE) AS infected,
       CAST(SUM(ROUND(l.l_quantity * l.l_tax)) AS DOUBLE) AS newly_infected,
       CAST(SUM(ROUND(l.l_quantity * l.l_discount * 4)) AS DOUBLE) AS on_art,
       CAST(SUM(CASE WHEN l.l_tax > 0.04::DOUBLE THEN 1 ELSE 0 END) AS DOUBLE) AS has_prep
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
GROUP BY 1,2,3,4,5,6,7,8,9)"""

COUNTY = """CASE {c} WHEN 1 THEN 'Homa_Bay' WHEN 2 THEN 'Kisii' WHEN 3 THEN 'Kisumu'
 WHEN 4 THEN 'Migori' WHEN 5 THEN 'Nyamira' WHEN 6 THEN 'Siaya' END"""

STD = f"""std AS (
SELECT 'PrEP-' || prep_coverage AS scenario, run_num, prep_coverage, year, node_id,
 {COUNTY.format(c='node_id')} AS county,
 CASE WHEN gender_code = 0 THEN 'Men' ELSE 'Women' END AS gender, age_lower,
 CAST(CASE age_lower WHEN 0 THEN 16 WHEN 16 THEN 36 WHEN 36 THEN 100 ELSE age_lower + 5 END AS INT) AS age_upper,
 hiv, risk, circ, population, infected, newly_infected, on_art, has_prep FROM report)"""

BYTIME = """bytime AS (
SELECT scenario, run_num, prep_coverage, node_id, county, gender, age_lower, age_upper, hiv, risk, year,
 SUM(population) AS population, SUM(infected) AS infected, SUM(newly_infected) AS newly_infected,
 SUM(on_art) AS on_art, SUM(has_prep) AS has_prep
FROM std GROUP BY ALL)"""

_PY = "CASE WHEN hiv = 0 THEN {pop} * 0.25::DOUBLE ELSE newly_infected * 0.25::DOUBLE / 2 END"

PT = f"""pt AS (
SELECT * FROM (SELECT *, {_PY.format(pop='((lag(population) OVER w + population) / 2)')} AS person_years,
  year AS year_start, round(year + 0.25::DOUBLE, 2) AS year_end, floor(year) AS year_floor
 FROM bytime WINDOW w AS (PARTITION BY scenario, run_num, node_id, gender, risk, hiv, age_lower ORDER BY year))
WHERE person_years IS NOT NULL)"""

PT_END = f"""pte AS (
SELECT * REPLACE (upper(risk[1]) || lower(risk[2:]) AS risk), {_PY.format(pop='population')} AS person_years,
  year - 0.25::DOUBLE AS year_start, year AS year_end, floor(year - 0.25::DOUBLE) AS year_floor
FROM bytime)"""

# The sweep has no risk strata.
SW = f"""bysweep AS (
SELECT scenario, run_num, prep_coverage, node_id, county, gender, age_lower, age_upper, hiv, year,
 SUM(population) AS population, SUM(infected) AS infected, SUM(newly_infected) AS newly_infected,
 SUM(has_prep) AS has_prep
FROM std GROUP BY ALL), sw AS (
SELECT * FROM (SELECT *, {_PY.format(pop='((lag(population) OVER w + population) / 2)')} AS person_years,
  floor(year) AS year_floor
 FROM bysweep WINDOW w AS (PARTITION BY scenario, run_num, node_id, gender, hiv, age_lower ORDER BY year))
WHERE person_years IS NOT NULL)"""

WAN = f"""wan AS (
SELECT * REPLACE ('PrEP-' || CASE WHEN (prep_coverage / 30) % 2 = 1 THEN '6mo-' ELSE '' END || prep_coverage AS scenario),
  CASE WHEN (prep_coverage / 30) % 2 = 1 THEN 'Const_180' ELSE 'Const_90' END AS prep_method,
  {_PY.format(pop='population')} AS person_years, floor(year - 0.25::DOUBLE) AS year_floor
FROM bytime)"""


def with_(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


DIMS = {
    "year": "DOUBLE", "period": "VARCHAR", "county": "VARCHAR", "gender": "VARCHAR", "age_lower": "INT",
    "age_upper": "INT", "risk": "VARCHAR", "source": "VARCHAR",
}
EVERYTHING = {
    "year": "NULL", "period": "NULL", "county": "'All'", "gender": "'Both'", "age_lower": "0",
    "age_upper": "100", "risk": "'All'", "source": "NULL",
}
RUN = "scenario, run_num"


def measure(src, name, value, by, where="TRUE", run=RUN, output=None, **fixed):
    """One long measure: ``by`` maps grouped dimensions to expressions."""
    shown = {**EVERYTHING, **fixed}
    cols = [f"CAST({by.get(d, shown[d])} AS {t}) AS {d}" for d, t in DIMS.items()]
    tag = f"'{output}' AS output, " if output else ""
    groups = ", ".join([run, *[f"CAST({e} AS {DIMS[d]})" for d, e in by.items()]])
    return (
        f"SELECT {run}, {tag}{', '.join(cols)}, '{name}' AS measure, CAST({value} AS DOUBLE) AS value\n"
        f"FROM {src} WHERE {where} GROUP BY {groups}"
    )


Y = {"year": "year"}
C = {"year": "year_floor"}
G, CO, R = {"gender": "gender"}, {"county": "county"}, {"risk": "risk"}
A = {"age_lower": "age_lower", "age_upper": "age_upper"}
SPLIT = {
    "age_lower": "CASE WHEN age_lower >= 15 THEN 15 ELSE 0 END",
    "age_upper": "CASE WHEN age_lower >= 15 THEN 100 ELSE 15 END",
}
ADULT = "age_lower >= 16 AND age_upper <= 36"
WOMEN = f"gender = 'Women' AND {ADULT}"
A1636 = {"age_lower": "16", "age_upper": "36"}
A1635 = {"age_lower": "16", "age_upper": "35"}

CIRC = "SUM(CASE WHEN circ = 1 THEN population ELSE 0 END) / NULLIF(SUM(population), 0)"
POP = "SUM(population)"
ART = "SUM(on_art)"
ART_SHARE = "CASE WHEN SUM(infected) = 0 THEN 0 ELSE SUM(on_art) / NULLIF(SUM(infected), 0) END"
PREV = "SUM(infected) / NULLIF(SUM(population), 0)"
RATE = "100 * SUM(newly_infected) / NULLIF(SUM(person_years), 0)"
COVER = "SUM(has_prep) / NULLIF(SUM(population - infected), 0)"


def calibration(output=True):
    """name -> SQL of the calibration outputs."""
    o = (lambda n: {"output": n}) if output else (lambda n: {})
    m = lambda n, name, value, by, where="TRUE", **f: (n, measure("std", name, value, by, where, **o(n), **f))
    men = "'Men'"
    return dict(
        [
            m("pop", "Population", POP, Y),
            m("pop_age", "Population", POP, {**Y, **A}),
            m("pop_county", "Population", POP, {**Y, **CO}),
            m("pop_county_age", "Population", POP, {**Y, **CO, **A}),
            m("pop_county_gender_age", "Population", POP, {**Y, **CO, **G, **A}),
            m("art", "ART", ART, Y, "age_lower >= 16 AND age_upper <= 100", age_lower="16", age_upper="100"),
            m("art_gender_age", "ART", ART, {**Y, **G, **SPLIT}),
            m("art_county_gender_age", "ART", ART, {**Y, **CO, **G, **SPLIT}),
            m("art_prev", "ART Proportion", ART_SHARE, Y),
            m("art_prev_gender", "ART Proportion", ART_SHARE, {**Y, **G}),
            m("art_prev_gender_adults", "ART Proportion", ART_SHARE, {**Y, **G}, "age_lower >= 16", age_lower="16", age_upper="100"),
            m("art_prev_gender_county", "ART Proportion", ART_SHARE, {**Y, **G, **CO}),
            m("prev", "Prevalence", PREV, Y, ADULT, **A1636),
            m("prev_val", "Prevalence", PREV, {}, "year >= 1998 AND year < 2000 AND age_lower >= 16 AND age_upper <= 100", year="1998.5", age_lower="16", age_upper="100"),
            m("prev_gender", "Prevalence", PREV, {**Y, **G}, ADULT, **A1636),
            m("prev_gender_age", "Prevalence", PREV, {**Y, **G, **A}, "age_lower >= 16 AND age_lower <= 36"),
            m("prev_county_gender", "Prevalence", PREV, {**Y, **CO, **G}, ADULT, **A1636),
            m("circ", "Circumcision", CIRC, Y, f"gender = 'Men' AND {ADULT}", gender=men, **A1636),
            m("circ_age", "Circumcision", CIRC, {**Y, **A}, "gender = 'Men' AND age_lower <= 16", gender=men),
            m("circ_county", "Circumcision", CIRC, {**Y, **CO}, f"gender = 'Men' AND {ADULT}", gender=men, **A1636),
        ]
    )


ORACLE: dict[str, str] = {}


def quantile(p, values="l"):
    """Linear interpolation, with the operands in the order of the percentile definition."""
    at = f"({p}::DOUBLE * (len({values}) - 1))"
    low, high = (f"{values}[CAST({f}({at}) AS INT) + 1]" for f in ("floor", "ceil"))
    return f"CASE WHEN {low} = {high} THEN {low} ELSE (ceil({at}) - {at}) * {low} + ({at} - floor({at})) * {high} END"


SORTED = "list_sort(list(value) FILTER (value IS NOT NULL)) AS l"


def bands(mean=True):
    q = ["round(mean, 6) AS mean"] if mean else []
    return ", ".join(q + [f"{quantile(p)} AS {n}" for p, n in ((0.5, "median"), (0.025, "lower"), (0.975, "upper"))])


ALL_DIMS = "year, period, county, gender, age_lower, age_upper, risk, source, measure"


def summary(src, keys, mean=True):
    return f"SELECT {keys}, {bands(mean)} FROM (SELECT {keys}, AVG(value) AS mean, {SORTED} FROM ({src}) GROUP BY ALL)"


def union(parts):
    return "\nUNION ALL\n".join(f"({p})" for p in parts)


# --- sources -----------------------------------------------------------------

ORACLE["scan_reports"] = with_(
    """SELECT 'PrEP-' || prep_coverage AS scenario, run_num, COUNT(*) AS n_rows, COUNT(DISTINCT node_id) AS n_nodes,
 SUM(population) AS population, SUM(newly_infected) AS newly_infected, SUM(has_prep) AS has_prep
FROM report GROUP BY 1, 2""", REPORT)
ORACLE["scan_mixed_headers"] = with_(
    """SELECT 'PrEP-' || prep_coverage AS scenario, run_num, COUNT(*) AS n_rows, SUM(population) AS population, SUM(newly_infected) AS newly_infected,
 SUM(CASE WHEN run_num % 3 < 2 THEN has_prep END) AS has_prep, SUM(CASE WHEN run_num % 3 = 2 THEN has_prep * 2 END) AS prep_received,
 MIN(risk) AS risk, MAX(year) AS year
FROM report GROUP BY 1, 2""", REPORT)
_REPLICATES = """SELECT 'PrEP-' || prep_coverage AS scenario, run_num, circ % 2 + 1 AS replicate, year, SUM(population) AS value
FROM report GROUP BY ALL"""
ORACLE["run_replicates"] = with_(
    f"""SELECT scenario, year, mean, round(median, 6) AS median, round(lower, 6) AS lower, round(upper, 6) AS upper
FROM ({summary(_REPLICATES, "scenario, year")})""", REPORT)
ORACLE["normalize_headers"] = with_(
    "SELECT node_id, risk, 2 * SUM(newly_infected) AS newly_infected, 2 * SUM(has_prep) AS has_prep FROM report GROUP BY 1, 2", REPORT)
ORACLE["run_id_from_name"] = """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'ReportHIVByAgeAndGender.csv' WHEN o_orderkey % 7 = 1 THEN 'Report_TPI_REP0001.csv'
 ELSE 'ReportHIVByAgeAndGender_TPI' || lpad(CAST(o_custkey % 250 AS VARCHAR), 4, '0') || '_REP0001.csv' END AS file_name,
 CASE WHEN o_orderkey % 7 IN (0, 1) THEN NULL ELSE CAST(o_custkey % 250 AS INT) END AS run_num FROM orders"""
ORACLE["incremental_ingest"] = with_(
    """SELECT 'PrEP-' || prep_coverage AS scenario, node_id, year, COUNT(*) AS n_rows, SUM(population) AS population,
 SUM(infected) AS infected FROM report GROUP BY 1, 2, 3""", REPORT)
ORACLE["scenario_completion"] = with_(
    """SELECT 'PrEP-' || prep_coverage AS scenario, COUNT(*) AS n_expected, COUNT(*) FILTER (NOT missing) AS n_arrived,
 COUNT(*) FILTER (NOT missing AND NOT late AND run_num % 3 = 0) AS n_replaced, 0 AS n_unexpected,
 MIN(run_num) FILTER (missing) AS first_missing,
 CASE WHEN bool_or(missing) THEN NULL WHEN bool_or(late) THEN 2 ELSE 1 END AS finished_in,
 CASE WHEN NOT bool_or(missing) THEN SUM(CASE WHEN late OR run_num % 3 = 0 THEN 2 * population ELSE population END) END AS population,
 CASE WHEN NOT bool_or(missing) THEN SUM(n) END AS n_rows
FROM (SELECT prep_coverage, run_num, prep_coverage = 90 AND run_num = 5 AS missing,
 prep_coverage >= 60 AND run_num % 4 = 1 AND NOT (prep_coverage = 90 AND run_num = 5) AS late, SUM(population) AS population, COUNT(*) AS n
 FROM report GROUP BY 1, 2) GROUP BY 1""", REPORT)
ORACLE["result_roundtrip"] = with_(
    f"SELECT scenario, run_num, year, gender, value FROM ({calibration(False)['prev_gender']})", REPORT, STD)

ORACLE["result_replace"] = with_(
    " UNION ALL ".join(
        f"""SELECT scenario, '{o}' AS output, COUNT(*) AS n_rows, MIN(value + {x}) AS least, MAX(value + {x}) AS most
FROM ({calibration(False)[o]}) GROUP BY scenario""" for o, x in (
            ("circ", "0::DOUBLE"), ("prev_gender", "CASE WHEN scenario = 'PrEP-30' THEN 1::DOUBLE ELSE 0 END"))
    ), REPORT, STD)

# --- scalar columns ----------------------------------------------------------

ORACLE["scale_counts"] = with_(
    """SELECT run_num, prep_coverage, node_id, gender_code, age_lower, hiv, risk, circ, year,
 population * 0.5::DOUBLE / 0.03::DOUBLE AS population, has_prep * 0.5::DOUBLE / 0.03::DOUBLE AS has_prep,
 newly_infected / 0.05::DOUBLE AS newly_scaled, on_art AS art_kept FROM report""", REPORT)
ORACLE["standardize_report"] = with_(
    "SELECT scenario, run_num, year, node_id, county, gender, age_lower, age_upper, hiv, risk, circ, population FROM std", REPORT, STD)
ORACLE["age_bin_upper"] = """
SELECT age_lower, COUNT(*) AS n,
 CAST(CASE age_lower WHEN 0 THEN 1 WHEN 1 THEN 5 WHEN 80 THEN 100 ELSE age_lower + 5 END AS INT) AS calibration,
 CAST(CASE age_lower WHEN 0 THEN 16 WHEN 16 THEN 18 WHEN 18 THEN 25 WHEN 25 THEN 36 WHEN 36 THEN 100 ELSE age_lower + 5 END AS INT) AS incidence,
 CAST(CASE age_lower WHEN 0 THEN 16 WHEN 16 THEN 36 WHEN 36 THEN 100 ELSE age_lower + 5 END AS INT) AS sweep
FROM (SELECT CAST(trunc(l_linenumber * l_quantity) AS INT) % 106 AS age_lower FROM lineitem) GROUP BY 1"""
ORACLE["calendar_year"] = with_(
    """SELECT year, SUM(population) AS population, year AS year_start, round(year + 0.25::DOUBLE, 2) AS year_end,
 floor(year) AS year_floor, year - 0.25::DOUBLE AS closed_start, floor(year - 0.25::DOUBLE) AS closed_floor,
 ceil(year) - 1 AS year_in FROM report GROUP BY year""", REPORT)
ORACLE["age_label"] = with_(
    """SELECT age_lower, age_upper, CASE WHEN age_lower = 0 THEN '0-1' ELSE age_lower || '-' || (age_upper - 1) END AS age,
 CAST(dense_rank() OVER (ORDER BY age_lower) AS INT) AS age_order, SUM(population) AS population
FROM std GROUP BY age_lower, age_upper""", REPORT, STD)
ORACLE["string_list_to_array"] = """
SELECT l_orderkey, l_linenumber,
 CASE WHEN l_linenumber % 3 = 0 THEN CAST(q AS VARCHAR) ELSE '[' || q || ',' || l_linenumber || ']' END AS text,
 CAST(CASE WHEN l_linenumber % 3 <> 0 THEN 2 END AS INT) AS n_items,
 CAST(CASE WHEN l_linenumber % 3 <> 0 THEN q END AS DOUBLE) AS item_0,
 CAST(CASE WHEN l_linenumber % 3 <> 0 THEN l_linenumber END AS DOUBLE) AS item_1
FROM (SELECT *, CAST(trunc(l_quantity) AS INT) AS q FROM lineitem)"""
ORACLE["scenario_attrs"] = """
SELECT o_orderkey, 'Baseline-' || six || 'PrEP-' || tail AS scenario, TRY_CAST(tail AS INT) AS prep_coverage,
 CASE WHEN six = '' THEN 'Const_90' ELSE 'Const_180' END AS prep_method
FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '6mo-' ELSE '' END AS six,
 CASE WHEN o_orderkey % 50 = 0 THEN 'none' ELSE CAST(o_custkey % 11 * 10 AS VARCHAR) END AS tail FROM orders)"""

# --- measures by run ---------------------------------------------------------

for _name, _sql in calibration(False).items():
    ORACLE[_name] = with_(_sql, REPORT, STD)
for _name in ("pop_age", "pop_county_age", "pop_county_gender_age"):
    _sql = calibration(False)[_name].replace(
        "WHERE TRUE", "WHERE age_lower IN (SELECT age_lower FROM report WHERE run_num = 0 AND year = floor(year) AND age_lower >= 16)"
    )
    ORACLE[_name] = with_(_sql, REPORT, STD)

_PT_COLUMNS = """SELECT scenario, run_num, node_id, gender, risk, hiv, age_lower, year, year_start, year_end, year_floor,
 population, person_years FROM """
ORACLE["person_time"] = with_(_PT_COLUMNS + "pt", REPORT, STD, BYTIME, PT)
ORACLE["person_time_end"] = with_(
    _PT_COLUMNS.replace("risk,", "upper(risk) AS risk,") + "pte", REPORT, STD, BYTIME, PT_END)

MID = (REPORT, STD, BYTIME, PT)
END = (REPORT, STD, BYTIME, PT_END)
YEARLY = f"{WOMEN} AND year_floor BETWEEN 1996 AND 2000"
POOLED = f"{WOMEN} AND year_floor BETWEEN 1998 AND 1999"
ECHO = {**A1635, "source": "'ECHO'"}


def inc(src, by, where="TRUE", run=RUN, output=None, **fixed):
    return measure(src, "Incidence", RATE, by, where, run, output, **fixed)


ORACLE["incidence_by_risk"] = with_(inc("pt", {**C, **G, **R}, YEARLY, **ECHO), *MID)
ORACLE["echo_incidence"] = with_(inc("pt", {**C, **G}, YEARLY, **ECHO), *MID)
ORACLE["echo_incidence_low_med"] = with_(
    inc("pt", {**C, **G}, YEARLY + " AND risk <> 'HIGH'", **ECHO, risk="'LOW+MEDIUM'"), *MID)
_POOL = [
    inc("pt", G, POOLED, output="inc_echo", **ECHO, year="1998.5"),
    inc("pt", G, POOLED + " AND risk <> 'HIGH'", output="inc_echo_low_med", **ECHO, year="1998.5", risk="'LOW+MEDIUM'"),
]
ORACLE["echo_incidence_pooled"] = with_(union(_POOL), *MID)
for _key, _trial, _where, _ages in (
    ("echo_incidence_end", "ECHO", "age_lower >= 16 AND age_upper < 100 AND year_floor >= 1996", A1635),
    ("mpya_incidence", "MPYA", "age_lower >= 16 AND age_upper < 37 AND year_floor >= 1997", {"age_lower": "18", "age_upper": "25"}),
):
    _tag = {**_ages, "source": f"'{_trial}'"}
    _where = f"gender = 'Women' AND {_where}"
    ORACLE[_key] = with_(
        union([
            inc("pte", {**C, **G, **R}, _where, output=f"inc_{_trial.lower()}_risk", **_tag),
            inc("pte", {**C, **G}, _where, output=f"inc_{_trial.lower()}", **_tag),
        ]), *END)
ORACLE["inc_age_gender"] = with_(inc("pt", {**C, **G, **A}), *MID)
ORACLE["inc_age_gender_risk"] = with_(inc("pt", {**C, **G, **A, **R}), *MID)
ORACLE["inc_adults_gender"] = with_(inc("pt", {**C, **G}, ADULT, **A1636), *MID)

SWEEP = (REPORT, STD, SW)
SRUN = "scenario, prep_coverage, run_num"
A105 = {"age_lower": "0", "age_upper": "105"}
ALLSEX = {**A105, "gender": "'All'"}
PERIOD = "year_floor BETWEEN 1997 AND 2000"


def new(by_where, output, **fixed):
    return measure("sw", "New Infections", "SUM(newly_infected)", C, by_where, SRUN, output, **fixed)


SW_OUT = {
    "inc": inc("sw", C, "TRUE", SRUN, "inc", **ALLSEX),
    "inc_1997_2000": inc("sw", {}, PERIOD, SRUN, "inc_1997_2000", **ALLSEX, period="'1997-2000'"),
    "inc_women": inc("sw", {**C, **G}, "gender = 'Women'", SRUN, "inc_women", **A105),
    "inc_echo": inc("sw", {**C, **G}, WOMEN, SRUN, "inc_echo", **A1635),
    "inc_echo_1997_2000": inc("sw", G, f"{WOMEN} AND {PERIOD}", SRUN, "inc_echo_1997_2000", **A1635, period="'1997-2000'"),
    "new_inf": new("TRUE", "new_inf", **ALLSEX),
    "new_inf_women": new("gender = 'Women'", "new_inf_women", **A105, gender="'Women'"),
    "new_inf_echo": new(WOMEN, "new_inf_echo", **A1635, gender="'Women'"),
    "prep_echo": measure("sw", "PrEP Coverage", COVER, {"year": "floor(year)"}, WOMEN, SRUN, "prep_echo", **A1635, gender="'Women'"),
}
for _key, _outs in {
    "inc_all": ["inc"], "inc_period": ["inc_1997_2000", "inc_echo_1997_2000"], "inc_women": ["inc_women"],
    "sweep_inc_echo": ["inc_echo"], "new_infections": ["new_inf", "new_inf_women", "new_inf_echo"],
    "prep_coverage": ["prep_echo"],
}.items():
    ORACLE[_key] = with_(union([SW_OUT[o] for o in _outs]), *SWEEP)

WRUN = "scenario, prep_coverage, prep_method, run_num"
WANING = (REPORT, STD, BYTIME, WAN)
WAN_SQL = union([
    inc("wan", {**C, **G}, f"{WOMEN} AND year_floor BETWEEN 1996 AND 2000", WRUN, "inc_echo", **A1635),
    measure("wan", "PrEP Coverage", COVER, {"year": "floor(year)"}, f"{WOMEN} AND floor(year) BETWEEN 1996 AND 2000", WRUN, "prep_echo", **A1635, gender="'Women'"),
])
ORACLE["waning_measures"] = with_(WAN_SQL, *WANING)
ORACLE["intervention_person_time"] = with_(
    union([
        measure("std", "PrEP Person-Years", "SUM(has_prep * 0.25::DOUBLE + newly_infected * 0.25::DOUBLE / 2 + on_art * 0.25::DOUBLE / 2)", {**G, **R}, output="prep_persontime_gender_risk"),
        measure("std", "New Infections", "SUM(newly_infected)", {**G, **R}, output="new_infections_gender_risk"),
    ]), REPORT, STD)
_PCT = "100 * SUM(has_prep) / NULLIF(SUM(population - infected), 0)"
ORACLE["prep_coverage_strata"] = with_(
    union([
        measure("std", "PrEP Coverage", _PCT, {**Y, **A, **G}, output="prep_age_gender"),
        measure("std", "PrEP Coverage", _PCT, {**Y, **A, **G, **R}, output="prep_age_gender_risk"),
        measure("std", "PrEP Coverage", _PCT, {**Y, **G, **R}, "age_lower >= 16", output="prep_adults_gender_risk", age_lower="16", age_upper="100"),
    ]), REPORT, STD)
ORACLE["suppressed_share"] = with_(
    measure("std", "Suppressed Proportion",
            "CASE WHEN SUM(on_art) = 0 THEN 0 ELSE SUM(CASE WHEN risk = 'LOW' THEN on_art ELSE 0 END) / NULLIF(SUM(on_art), 0) END",
            {**Y, **G}), REPORT, STD)

# --- summaries and contrasts -------------------------------------------------

SUITE = union(calibration().values())
ORACLE["incremental_measures"] = with_(SUITE, REPORT, STD)
ORACLE["run_summary"] = with_(summary(SUITE, f"scenario, output, {ALL_DIMS}"), REPORT, STD)
ORACLE["run_summary_strict"] = with_(
    summary(calibration(False)["pop_county"], f"scenario, {ALL_DIMS}"), REPORT, STD)
ORACLE["run_summary_any_size"] = with_(
    summary(calibration(False)["prev_gender"], f"scenario, {ALL_DIMS}"), REPORT, STD)
SW_KEYS = f"scenario, prep_coverage, output, {ALL_DIMS}"
ORACLE["scenario_union"] = with_(
    f"SELECT *, CAST(NULL AS VARCHAR) AS prep_method FROM ({summary(SW_OUT['inc_echo'], SW_KEYS)}) UNION ALL BY NAME "
    f"{summary(WAN_SQL, SW_KEYS + ', prep_method')}", REPORT, STD, BYTIME, WAN, SW)
ORACLE["run_trajectories"] = with_(
    f"SELECT *, CASE WHEN run_num > 3 THEN 'AB' ELSE 'KP' END AS sim FROM ({calibration(False)['prev_gender']}) WHERE year <= 2000",
    REPORT, STD)
ORACLE["target_year"] = with_(
    f"""SELECT scenario, gender, CAST(target AS DOUBLE) AS target, MIN(CASE WHEN median >= target THEN year END) AS target_year
FROM (SELECT scenario, gender, year, {quantile(0.5)} AS median FROM (SELECT scenario, gender, year, {SORTED} FROM ({calibration(False)['art_prev_gender']}) GROUP BY ALL)),
 (VALUES (0.39::DOUBLE), (0.41::DOUBLE), (0.9::DOUBLE * 0.9::DOUBLE), (0.95::DOUBLE * 0.95::DOUBLE)) t(target)
GROUP BY 1, 2, 3""", REPORT, STD)


def contrast(src, keys, value, by):
    base = f"SELECT *, MAX(CASE WHEN prep_coverage = 0 THEN value END) OVER (PARTITION BY {keys}) AS value_base FROM ({src})"
    shown = ", ".join(x for x in (by, "prep_coverage") if x)
    changed = f"SELECT * REPLACE ({value} AS value) FROM ({base}) WHERE prep_coverage > 0"
    return summary(changed, shown, False)


_RR = "CASE WHEN value_base = 0 AND value > 0 THEN 'inf'::DOUBLE ELSE value / NULLIF(value_base, 0) END"
_SAVED = "-(value - value_base)"
_RDIMS = "gender, age_lower, age_upper, county, measure"
ORACLE["relative_risk"] = with_(
    contrast(f"SELECT * FROM ({SW_OUT['inc_echo']}) WHERE year >= 1996", "run_num, year", _RR, "year, " + _RDIMS), *SWEEP)
ORACLE["relative_risk_period"] = with_(
    contrast(SW_OUT["inc_echo_1997_2000"], "run_num", _RR, "period, " + _RDIMS), *SWEEP)
ORACLE["averted_by_year"] = with_(
    union([
        f"SELECT *, '{o}' AS output FROM ({contrast(SW_OUT[o], 'run_num, year', _SAVED, 'year')}) WHERE year >= 1996"
        for o in ("new_inf", "new_inf_echo")
    ]), *SWEEP)
ORACLE["averted_total"] = with_(
    union([
        "SELECT *, '{}' AS output FROM ({})".format(
            o, contrast(f"SELECT run_num, prep_coverage, SUM(value) AS value FROM ({SW_OUT[o]}) WHERE year BETWEEN 1997 AND 2000 GROUP BY ALL",
                        "run_num", _SAVED, ""))
        for o in ("new_inf", "new_inf_echo")
    ]), *SWEEP)
ORACLE["coverage_check"] = with_(
    f"SELECT *, 100 * median AS percent FROM ({summary(SW_OUT['prep_echo'], SW_KEYS)}) WHERE year = 1998",
    *SWEEP)
ORACLE["sweep_series"] = with_(
    f"SELECT * FROM ({summary(union([SW_OUT[o] for o in ('inc_echo', 'new_inf', 'new_inf_echo')]), SW_KEYS)}) WHERE year BETWEEN 1996 AND 2000",
    *SWEEP)
ORACLE["waning_chart"] = with_(
    f"""SELECT *, CAST(CASE prep_method WHEN 'Exp_90' THEN 1 WHEN 'Const_90' THEN 2 WHEN 'Const_100' THEN 3 WHEN 'Exp_180' THEN 4
 WHEN 'Const_180' THEN 5 END AS INT) AS method_order FROM ({summary(WAN_SQL, SW_KEYS + ', prep_method')})""", *WANING)

# --- channels ----------------------------------------------------------------

# Same grid as the Spark side: configured years, bins and sexes per channel.
GRID_CONFIG = {
    "Prevalence": ([1995, 1996.5], [(0, 16), (16, 36), (16, 100)], [0, 1, 2]),
    "Population": ([1996, 1997.25], [(0, 100)], [0, 2]),
    "OnART": ([1999.5, 2000.25], [(16, 100)], [0, 1]),
    "ARTCoverage": ([1997], [(16, 100), (0, 100)], [2]),
    "Incidence": ([1996], [(16, 36)], [0, 1, 2]),
    "PrevDiscordMalePositive": ([1997, 1998], [(16, 36)], [0]),
    "PrevDiscordFemalePositive": ([1997, 1998], [(16, 100)], [1, 2]),
    "ExternalStableDiscordantConversionRate": ([1996, 1997, 2005], [(15, 30), (0, 100)], [0, 2]),
}
CH = """ch AS (SELECT 'PrEP-' || prep_coverage AS scenario, *, population AS num_marital, infected AS num_concordant_marital FROM report)"""
WHOLE = "range(CAST(ceil(lo) AS INT), CAST(floor(hi) AS INT) + 1)"
WHOLE_BUT_LAST = "range(CAST(ceil(lo) AS INT), CAST(floor(hi) AS INT))"
HALF = "[h + 0.5::DOUBLE FOR h IN range(2000, CAST(floor(hi) AS INT))]"


def grid(channel, own=None, nodes="both", src="ch"):
    years, bins, sexes = GRID_CONFIG[channel]
    config = "[" + ", ".join(f"{y}::DOUBLE" for y in years) + "]"
    all_years = f"list_distinct(list_concat({own}::DOUBLE[], {config}))" if own else config
    places = {"each": "list_distinct(list(node_id))", "both": "list_append(list_distinct(list(node_id)), 0)"}[nodes]
    return f"""SELECT scenario, run_num, '{channel}' AS channel, y AS year, g AS gender_code, b[1] AS age_lower, b[2] AS age_upper, n AS node_id
FROM (SELECT scenario, run_num, unnest({all_years}) AS y, ns FROM
  (SELECT scenario, run_num, MIN(year) AS lo, MAX(year) AS hi, {places} AS ns FROM {src} GROUP BY 1, 2)),
 unnest(ns) t1(n), (SELECT unnest([{', '.join(f'[{a}, {b}]' for a, b in bins)}]) AS b), (SELECT unnest({sexes}) AS g)"""


def cells(channel, grid_sql, src, sums, where="TRUE", join="JOIN"):
    return f"""SELECT g.scenario, g.run_num, g.channel, g.year, g.node_id, g.gender_code, g.age_lower, g.age_upper,
 {', '.join(f'COALESCE(SUM(d.{c}), 0) AS {c}' for c in sums)}, COUNT(d.scenario) AS n
FROM ({grid_sql}) g {join} (SELECT * FROM {src} WHERE {where}) d ON d.scenario = g.scenario AND d.run_num = g.run_num
 AND round(d.year, 3) = round(g.year, 3) AND d.age_lower >= g.age_lower AND d.age_lower < g.age_upper
 AND (g.gender_code = 2 OR d.gender_code = g.gender_code) AND (g.node_id = 0 OR d.node_id = g.node_id)
GROUP BY ALL"""


def result(channel, result_sql, inner, tag=True):
    label = f", '{channel}' AS channel" if tag else ""
    return f"""SELECT scenario, run_num, year AS "Year", node_id AS "Node",
 CASE gender_code WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' ELSE 'Both' END AS "Gender",
 '[' || age_lower || ':' || age_upper || ')' AS "AgeBin", CAST({result_sql} AS DOUBLE) AS "Result"{label} FROM ({inner})"""


def safe(num, den):
    return f"CASE WHEN {den} = 0 THEN 0 ELSE ({num}) / NULLIF({den}, 0) END"


G_PREV, G_POP, G_ART = grid("Prevalence", WHOLE), grid("Population", WHOLE), grid("OnART", HALF)
ORACLE["channel_grid"] = with_(
    "SELECT * REPLACE (round(year, 3) AS year) FROM (" + union([
        G_PREV, G_ART, grid("PrevDiscordMalePositive", None, "each"), grid("Incidence", WHOLE_BUT_LAST)]) + ")", REPORT, CH)
ORACLE["channel_prevalence"] = with_(
    result("Prevalence", safe("infected", "population"), cells("Prevalence", G_PREV, "ch", ["infected", "population"])), REPORT, CH)
ORACLE["channel_population"] = with_(
    result("Population", "population", cells("Population", G_POP, "ch", ["population"])), REPORT, CH)
ORACLE["channel_strict"] = with_(
    result("Population", "population", cells("Population", G_POP, "ch", ["population"])), REPORT,
    CH.replace("FROM report", "FROM (SELECT * REPLACE (run_num % 2 AS run_num, 1 AS node_id) FROM report)"))
ORACLE["channel_on_art"] = with_(result("OnART", "on_art", cells("OnART", G_ART, "ch", ["on_art"])), REPORT, CH)
ORACLE["channel_art_coverage"] = with_(
    result("ARTCoverage", safe("on_art", "infected"), cells("ARTCoverage", grid("ARTCoverage", WHOLE), "ch", ["on_art", "infected"])), REPORT, CH)
_DISC = safe("num_marital - num_concordant_marital", "num_marital")
_MAR = ["num_marital", "num_concordant_marital"]
ORACLE["channel_discordance"] = with_(
    union([
        result("PrevDiscordMalePositive", _DISC, cells("x", grid("PrevDiscordMalePositive", None, "each"), "ch", _MAR, "hiv = 1")),
        result("PrevDiscordFemalePositive", _DISC, cells("x", grid("PrevDiscordFemalePositive"), "ch", _MAR, "hiv = 0")),
    ]), REPORT, CH)
_EMPTY = "SELECT scenario, run_num, channel, year, node_id, gender_code, age_lower, age_upper, 'none' AS skipped FROM ({}) WHERE n = 0"
ORACLE["channel_all"] = "WITH a AS ({}) SELECT * FROM a".format(
    union(ORACLE[k] for k in ("channel_prevalence", "channel_population", "channel_on_art", "channel_art_coverage", "channel_discordance")))
ORACLE["channel_completeness"] = with_(
    union([
        _EMPTY.format(cells("x", G_POP, "ch", ["population"], join="LEFT JOIN")),
        _EMPTY.format(cells("x", G_ART, "ch", ["on_art"], join="LEFT JOIN")),
        _EMPTY.format(cells("x", grid("PrevDiscordMalePositive", None, "each"), "ch", _MAR, "hiv = 1", join="LEFT JOIN")),
    ]), REPORT, CH)
ORACLE["channel_unsupported"] = with_(
    "SELECT DISTINCT prep_coverage, 'Fertility_' || node_id AS channel FROM report WHERE node_id % 3 = 2", REPORT)
ORACLE["incidence_annualized"] = with_(
    result(
        "Incidence",
        "CASE WHEN population > 0 THEN newly_infected_annualized / NULLIF(population - infected - newly_infected, 0) ELSE 0 END",
        cells("x", grid("Incidence", WHOLE_BUT_LAST), "yr", ["newly_infected_annualized", "population", "infected", "newly_infected"]),
        tag=False,
    ),
    REPORT, CH,
    """dated AS (SELECT *, ceil(year) - 1 AS year_in FROM ch),
yr AS (SELECT d.* EXCLUDE (year, year_in), d.year_in AS year, s.newly_infected_annualized FROM dated d JOIN
 (SELECT scenario, run_num, node_id, gender_code, age_lower, circ, risk, year_in, SUM(newly_infected) AS newly_infected_annualized
  FROM dated GROUP BY ALL) s USING (scenario, run_num, node_id, gender_code, age_lower, circ, risk, year_in)
 WHERE d.year = d.year_in + 0.5)""")
RELATIONS = """rel AS (SELECT 'PrEP-' || (l.l_partkey % 4) * 30 AS scenario, CAST(l.l_suppkey % 8 AS INT) AS run_num,
 CAST(year(o.o_orderdate) + (month(o.o_orderdate) - 1) / CAST(12 AS DOUBLE) AS DOUBLE) AS year,
 CAST(o.o_custkey % 6 + 1 AS INT) AS node_id, CAST(10 + 5 * l.l_linenumber AS INT) AS age_lower,
 CASE WHEN l.l_suppkey % 2 = 0 THEN 0 ELSE 1 END AS gender_code,
 CASE WHEN l.l_returnflag = 'R' THEN 0 ELSE 1 END AS was_marital,
 CASE WHEN l.l_linestatus = 'F' THEN 1 ELSE 0 END AS by_marital_partner
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
stable AS (SELECT * REPLACE (ceil(year) - 1 AS year), CAST(by_marital_partner = 0 AS INT)::DOUBLE AS ext,
 CAST(by_marital_partner = 1 AS INT)::DOUBLE AS int_ FROM rel WHERE was_marital = 1)"""
ORACLE["external_infection_rate"] = with_(
    result("x", safe("ext", "(ext + int_)"),
           cells("x", grid("ExternalStableDiscordantConversionRate", None, "both", "rel"), "stable", ["ext", "int_"], join="LEFT JOIN"),
           tag=False), RELATIONS)

# --- survey side -------------------------------------------------------------

OBS = """obs AS (
SELECT year, 'County_' || node_id AS county, CASE WHEN gender_code = 0 THEN 'Men' ELSE 'Women' END AS gender,
 age_lower, CAST(CASE age_lower WHEN 0 THEN 16 WHEN 16 THEN 36 ELSE 100 END AS INT) AS age_upper,
 SUM(infected) / NULLIF(SUM(population), 0) AS value, SUM(population) AS pop
FROM report GROUP BY ALL)"""
SHARE = "SELECT year, county, gender, age_lower, age_upper, value, value * 0.5::DOUBLE AS lower, (value + 1) / 2 AS upper FROM obs"
ORACLE["observed_standardize"] = with_(
    f"SELECT *, unnest(['HIV prevalence', 'ART Proportion']) AS measure FROM ({SHARE})", REPORT, OBS)
ORACLE["parse_age_bin"] = """
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 5 THEN 'All' ELSE '[' || lo || ':' || (lo + q) || ')' END AS "AgeBin",
 CASE WHEN l_quantity < 5 THEN NULL ELSE lo END AS age_lower, CASE WHEN l_quantity < 5 THEN NULL ELSE lo + q END AS age_upper
FROM (SELECT *, l_linenumber * 5 AS lo, CAST(trunc(l_quantity) AS INT) AS q FROM lineitem)"""


def marginals(skip=1999):
    row = "SELECT year, {c} AS county, 'Both' AS gender, {a} AS age_lower, {b} AS age_upper, SUM(pop) AS value, 'Population' AS measure FROM obs WHERE {w} GROUP BY ALL"
    f = lambda county, ages, where: row.format(
        c="county" if county else "'All'", a="age_lower" if ages else "0", b="age_upper" if ages else "100", w=where)
    return union([
        "SELECT year, county, gender, age_lower, age_upper, pop AS value, 'Population' AS measure FROM obs",
        f(True, True, "TRUE"), f(True, False, f"year <> {skip}"), f(False, True, f"year <> {skip}"), f(False, False, "TRUE"),
    ])


ORACLE["observed_marginals"] = with_(marginals(), REPORT, OBS)
_ARTM = union([
    "SELECT year, county, gender, age_lower, age_upper, pop AS value, 'ART' AS measure FROM obs",
    "SELECT year, 'All' AS county, gender, age_lower, age_upper, SUM(pop) AS value, 'ART' AS measure FROM obs GROUP BY ALL",
])
ORACLE["art_marginal"] = with_(_ARTM, REPORT, OBS)
_W = "CASE WHEN COUNT({0}) = COUNT(*) THEN round(SUM(p * {0}) / NULLIF(SUM(p), 0), 6) END AS {0}"
ORACLE["weighted_prevalence"] = with_(
    f"""SELECT year, county, gender, age_lower, age_upper, 'HIV prevalence' AS measure, round(value, 6) AS value,
 round(lower, 6) AS lower, round(upper, 6) AS upper FROM ({SHARE})
UNION ALL SELECT 1998, 'All', 'Both', 15, 65, 'HIV prevalence', * FROM (
SELECT {', '.join(_W.format(c) for c in ('value', 'lower', 'upper'))}
FROM (SELECT county, value AS p FROM ({marginals()}) WHERE year = 1999 AND gender = 'Both' AND county <> 'All') w
LEFT JOIN (SELECT * FROM ({SHARE}) WHERE year = 1998) s USING (county))""", REPORT, OBS)
ORACLE["binomial_bounds"] = """WITH RECURSIVE """ + ",\n".join([
    REPORT,
    """obs AS (SELECT year AS "Year", 'County_' || node_id AS "County", CASE WHEN gender_code = 0 THEN 'Male' ELSE 'Female' END AS "Gender",
 '[' || age_lower || ':' || CASE age_lower WHEN 0 THEN 16 WHEN 16 THEN 36 ELSE 100 END || ')' AS "AgeBin",
 SUM(infected) / NULLIF(SUM(population), 0) AS value, SUM(population) AS pop, CAST(SUM(infected) AS BIGINT) AS x, CAST(SUM(population) AS BIGINT) AS n
FROM report GROUP BY ALL)""",
    # Bisection on the binomial tail P(X >= k0), summed term by term.
    """search AS (SELECT x, n, k0, target, 0::DOUBLE AS lo, 1::DOUBLE AS hi, 0 AS step FROM (
  SELECT DISTINCT x, n, x AS k0, 0.025::DOUBLE AS target FROM obs WHERE x > 0
  UNION ALL SELECT DISTINCT x, n, x + 1, 0.975::DOUBLE FROM obs WHERE x < n)
 UNION ALL SELECT x, n, k0, target, CASE WHEN tail < target THEN mid ELSE lo END, CASE WHEN tail < target THEN hi ELSE mid END, step + 1
 FROM (SELECT *, list_sum([exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(mid) + (n - k) * ln(1 - mid)) FOR k IN range(k0, n + 1)]) AS tail
  FROM (SELECT *, (lo + hi) / 2 AS mid FROM search WHERE step < 40)))""",
    "found AS (SELECT x, n, target, (lo + hi) / 2 AS bound FROM search WHERE step = 40)",
]) + """
SELECT "Year", "County", "Gender", "AgeBin", value, pop, round(COALESCE(a.bound, 0), 6) AS lower, round(COALESCE(b.bound, 1), 6) AS upper
FROM obs LEFT JOIN found a ON a.x = obs.x AND a.n = obs.n AND a.target < 0.5
LEFT JOIN found b ON b.x = obs.x AND b.n = obs.n AND b.target > 0.5"""
_CAL = calibration(False)
_R0 = "run_num = 0 AND scenario = 'PrEP-0'"
ORACLE["gender_split_coverage"] = with_(
    f"""SELECT v.year, round(v.value / NULLIF(m, 0), 6) AS art_prev_men, round(v.value * m, 6) AS art_prev_women
FROM (SELECT * FROM ({_CAL['art_prev']}) WHERE {_R0}) v,
 (SELECT (pm + pw * (cw / NULLIF(cm, 0))) / NULLIF(pm + pw, 0) AS m FROM
  (SELECT MAX(CASE WHEN gender = 'Men' THEN value END) AS pm, MAX(CASE WHEN gender = 'Women' THEN value END) AS pw
   FROM ({_CAL['prev_gender']}) WHERE {_R0} AND year = 1998),
  (SELECT MAX(CASE WHEN gender = 'Men' THEN value END) AS cm, MAX(CASE WHEN gender = 'Women' THEN value END) AS cw
   FROM ({_CAL['art_prev_gender']}) WHERE {_R0} AND year = 1999))""", REPORT, STD)

# overlay name -> model output, model filter, survey table, survey filter, facet, label
_PROVINCE = "county = 'All' AND gender = 'Both'"
_SEX = "county = 'All' AND gender <> 'Both'"
_CSEX = "county <> 'All' AND gender <> 'Both'"
_DET = "NOT (age_lower = 0 AND age_upper = 100)"
_AD = "age_lower = 16 AND age_upper = 36"
_AGE = "CASE WHEN age_lower = 0 THEN '0-1' ELSE age_lower || '-' || (age_upper - 1) END"
_T = "year <= 2000"
OVERLAYS = [
    ("pop", "pop", _T, "population", f"{_PROVINCE} AND age_lower = 0 AND age_upper = 100", "''", "NULL"),
    ("pop_age", "pop_age", _T, "population", f"{_PROVINCE} AND {_DET}", _AGE, "'Census'"),
    ("pop_county", "pop_county", _T, "population", "county <> 'All' AND gender = 'Both' AND age_lower = 0 AND age_upper = 100", "county", "NULL"),
    ("pop_county_age", "pop_county_age", _T, "population", "county <> 'All' AND gender = 'Both' AND year <> 2019", "county || ' / ' || age_lower", "NULL"),
    ("pop_age_single", "pop_age", "year = 1997", "population", f"{_PROVINCE} AND {_DET}", _AGE, "'Census'"),
    ("art", "art", _T, "art", _PROVINCE, "''", "NULL"),
    ("art_gender_age", "art_gender_age", _T, "art", _SEX, "age_lower || ' / ' || gender", "NULL"),
    ("art_gender_adult", "art_gender_age", f"{_T} AND age_lower = 16", "art", f"{_SEX} AND age_lower = 16", "age_lower || ' / ' || gender", "NULL"),
    ("art_county_gender_age", "art_county_gender_age", _T, "art", _CSEX, "county || ' / ' || age_lower", "NULL"),
    ("art_prev", "art_prev", _T, "share", "gender = 'Both'", "''", "NULL"),
    ("art_prev_gender", "art_prev_gender", _T, "share", "gender <> 'Both'", "gender", "'PHIA'"),
    ("art_prev_gender_all_years", "art_prev_gender", "TRUE", "share", "gender <> 'Both'", "gender", "'PHIA'"),
    ("art_prev_gender_adults", "art_prev_gender_adults", "TRUE", "share", "gender <> 'Both'", "gender", "'PHIA'"),
    ("art_prev_gender_county", "art_prev_gender_county", "TRUE", None, None, "county || ' / ' || gender", "NULL"),
    ("prev", "prev", _T, "share", _PROVINCE, "''", "survey"),
    ("prev_gender", "prev_gender", _T, "share", f"{_SEX} AND {_AD}", "gender", "survey"),
    ("prev_gender_age", "prev_gender_age", f"{_T} AND age_upper <= 36", "share", f"{_SEX} AND NOT ({_AD}) AND age_upper <= 36", f"gender || ' / ' || {_AGE}", "survey"),
    ("prev_county_gender", "prev_county_gender", _T, "share", f"{_CSEX} AND {_AD}", "gender || ' / ' || county", "NULL"),
    ("circ", "circ", _T, "circumcision", "county = 'All' AND year <> 2003", "''", "NULL"),
    ("circ_recent", "circ", f"year >= 2000 AND {_T}", "circumcision", "county = 'All' AND year <> 2003", "''", "NULL"),
    ("circ_all_years", "circ", "TRUE", "circumcision", "county = 'All' AND year <> 2003", "''", "NULL"),
    ("circ_age_young", "circ_age", "age_lower >= 16 AND age_upper <= 25", None, None, "CAST(age_lower AS VARCHAR)", "NULL"),
    ("circ_age", "circ_age", "TRUE", None, None, "CAST(age_lower AS VARCHAR)", "NULL"),
    ("circ_county", "circ_county", "TRUE", "circumcision", "county <> 'All'", "county", "NULL"),
]
_SURVEY = "CASE WHEN year IN (2003, 2008.5) THEN 'DHS' WHEN year IN (2007, 2012) THEN 'AIS' WHEN year = 2018 THEN 'PHIA' END"


def overlay_sql():
    parts = []
    row = """SELECT {scenario} AS scenario, '{name}' AS overlay, '{origin}' AS origin, CAST({source} AS VARCHAR) AS source, {facet} AS facet,
 year, county, gender, age_lower, age_upper, {value} AS value, {lower} AS lower, {upper} AS upper FROM {src} WHERE {where}"""
    for name, output, mwhere, table, owhere, facet, label in OVERLAYS:
        parts.append(row.format(
            scenario="scenario", name=name, origin="Model", source="NULL", facet=facet, value="median", lower="lower",
            upper="upper", src="summ", where=f"output = '{output}' AND {mwhere}"))
        if table:
            bounded = table in ("share", "circumcision")
            parts.append(row.format(
                scenario="CAST(NULL AS VARCHAR)", name=name, origin="Observed", source=_SURVEY if label == "survey" else label,
                facet=facet, value="value", lower="lower" if bounded else "CAST(NULL AS DOUBLE)",
                upper="upper" if bounded else "CAST(NULL AS DOUBLE)", src=table, where=owhere))
    return union(parts)


ORACLE["observed_overlay"] = with_(
    overlay_sql(), REPORT, STD, OBS,
    f"summ AS MATERIALIZED ({summary(SUITE, 'scenario, output, ' + ALL_DIMS)})",
    f"population AS ({marginals()})",
    f"art0 AS ({_ARTM}), art AS (SELECT * FROM art0 UNION ALL SELECT * REPLACE ('Both' AS gender) FROM art0)",
    f"share0 AS ({SHARE}), share AS (SELECT * FROM share0 UNION ALL SELECT * REPLACE ('All' AS county) FROM share0 WHERE year < 1998 "
    "UNION ALL SELECT * REPLACE ('All' AS county, 'Both' AS gender) FROM share0 WHERE year < 1998)",
    "circumcision AS (SELECT * FROM share WHERE gender = 'Men')")
ORACLE["observed_overlay_incidence"] = with_(
    f"""SELECT scenario, year, 'Model: ' || risk || ' risk' AS source, median AS value, lower, upper
FROM ({summary(union(_POOL), 'scenario, output, ' + ALL_DIMS)})
UNION ALL SELECT NULL, 2016.5, 'ECHO', 1.21, 0.678, 1.90""", *MID)
ORACLE["validation_check"] = with_(
    f"""SELECT county, gender, age_lower, age_upper, m.year AS model_year, median AS model, lower AS model_lower,
 upper AS model_upper, s.year AS observed_year, s.value AS observed, s.value BETWEEN m.lower AND m.upper AS inside
FROM (SELECT *, round(year, 3) AS k FROM (
  {summary("SELECT * FROM (" + _CAL['prev_county_gender'] + ") WHERE scenario = 'PrEP-30'", "county, gender, age_lower, age_upper, year", False)})) m
FULL JOIN (SELECT {COUNTY.format(c="CAST(county[8:] AS INT)")} AS county, gender, age_lower, age_upper, year, round(year, 3) AS k, value FROM obs) s
 USING (county, gender, age_lower, age_upper, k)""", REPORT, STD, OBS)
FIT = f"""pg AS ({_CAL['prev_gender']}),
pts0 AS (SELECT year, gender, county, age_lower, age_upper, value FROM pg WHERE run_num = 0 AND scenario = 'PrEP-60' AND year = floor(year)),
pts AS (SELECT * FROM pts0 UNION ALL SELECT * REPLACE (year + 100 AS year) FROM pts0 WHERE year = 2000),
model AS (SELECT * FROM pg),
sse AS (SELECT m.scenario, m.run_num, CASE WHEN COUNT(m.value - p.value) = COUNT(*) THEN SUM(pow(m.value - p.value, 2)) END AS sse
 FROM pts p LEFT JOIN model m ON round(m.year, 3) = round(p.year, 3) AND m.gender = p.gender AND m.county = p.county
 AND m.age_lower = p.age_lower AND m.age_upper = p.age_upper GROUP BY 1, 2)"""
ORACLE["fit_sse"] = with_("SELECT scenario, run_num, round(sse, 9) AS sse FROM sse", REPORT, STD, FIT)
_BEST = "SELECT scenario, run_num FROM (SELECT scenario, run_num, rank() OVER (ORDER BY sse) AS r FROM sse WHERE sse IS NOT NULL) WHERE r <= {}"
ORACLE["best_runs"] = with_(
    f"SELECT * FROM model WHERE (scenario, run_num) IN ({_BEST.format(3)}) AND year <= 2000", REPORT, STD, FIT)

# --- events ------------------------------------------------------------------

DUR = """dur AS (SELECT individual_id, event_id, CASE WHEN individual_id % 2 = 0 THEN 'Const_90' ELSE 'Const_180' END AS prep_method,
 age AS start, "end", "end" - age AS duration FROM (
 SELECT *, lead(age) OVER (PARTITION BY individual_id ORDER BY age, event_id) AS "end" FROM (
  SELECT event_id, user_id AS individual_id, event_type, epoch_us(ts) / 86400000000.0::DOUBLE AS age FROM events))
 WHERE event_type = 'signup' AND "end" IS NOT NULL)"""
ORACLE["event_durations"] = with_(
    'SELECT individual_id, event_id, prep_method, round(start, 6) AS start, round("end", 6) AS "end", round(duration, 6) AS duration FROM dur', DUR)
ORACLE["event_durations_hot"] = ORACLE["event_durations"]
ORACLE["duration_histogram"] = with_(
    """SELECT prep_method, bin, round(bin * 0.25::DOUBLE, 6) AS centre, n, round(n / SUM(n) OVER (), 6) AS share
FROM (SELECT prep_method, CAST(ceil(duration / 0.25::DOUBLE - 0.5::DOUBLE) AS BIGINT) AS bin, COUNT(*) AS n FROM dur
 WHERE duration BETWEEN 0 AND 2 GROUP BY 1, 2)""", DUR)
ORACLE["id_uniqueness"] = """
SELECT COUNT(*) AS n, COUNT(DISTINCT user_id) AS n_unique FROM (SELECT DISTINCT event_id % 3 AS node_id, user_id FROM events)"""

# --- parameter sets ----------------------------------------------------------

P = [f"p{i}" for i in range(64)]
PARAMS = f"""params AS (SELECT vec_id AS parameterization_id, CASE WHEN label % 2 = 0 THEN 'AB' ELSE 'KP' END AS source,
 {", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {p}" for i, p in enumerate(P))},
 CAST(abs(embedding[1]) AS DOUBLE) AS likelihood FROM embeddings)"""
LONG = f"""long AS (SELECT parameterization_id, source, parameter, value FROM (
 SELECT parameterization_id, source, unnest({P}) AS parameter, unnest([{", ".join(P)}]) AS value FROM params))"""
ORACLE["param_unpivot"] = with_("SELECT * FROM long", PARAMS, LONG)
_IN = "value BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1)"
ORACLE["param_boxplot"] = with_(
    f"""SELECT parameter, source, any_value(b.min) AS min, any_value(q1) AS q1, any_value(b.median) AS median,
 any_value(q3) AS q3, any_value(b.max) AS max, MIN(CASE WHEN {_IN} THEN value END) AS whisker_low,
 MAX(CASE WHEN {_IN} THEN value END) AS whisker_high, COUNT(*) FILTER (NOT {_IN}) AS n_outliers
FROM long JOIN (SELECT parameter, source, l[1] AS min, {quantile(0.25)} AS q1, {quantile(0.5)} AS median,
 {quantile(0.75)} AS q3, l[-1] AS max FROM (SELECT parameter, source, {SORTED} FROM long GROUP BY 1, 2)) b
 USING (parameter, source) GROUP BY 1, 2""", PARAMS, LONG)
ORACLE["param_constrain"] = with_("SELECT parameterization_id, least(p2, p3) AS low, p3 AS medium FROM params", PARAMS)


def entries(*items):
    """(target, condition, values) -> long rows."""
    return union(
        f"SELECT parameterization_id, '{t}' AS target, CAST(unnest(range({len(v)})) AS INT) AS position, round(CAST(unnest([{', '.join(v)}]) AS DOUBLE), 6) AS value FROM params WHERE {w}"
        for t, w, v in items
    )


_LINK = "Actual_IndividualIntervention_Config__KP_PreART_Link.Ramp_"
ORACLE["param_map"] = with_(
    entries(
        ("Base_Infectivity", "TRUE", ["exp(p0)"]),
        (_LINK + "Min", "TRUE", ["least(p1, p2)"]), (_LINK + "Max", "TRUE", ["greatest(p1, p2)"]),
        ("Male_To_Female_Relative_Infectivity_Multipliers", "TRUE", ["p0", "p0", "p3"]),
        ("Weighting_Matrix_RowMale_ColumnFemale__KP_RiskAssortivity", "TRUE",
         ["p1", "1 - p1", "0", "1 - p1", "p1", "p1", "0", "p1", "1 - p1"]),
        ("Seed_Year__High_A", "TRUE", ["p0"]), ("Seed_Year__High_B", "TRUE", ["p0"]),
        ("Condom_Max", "TRUE", ["p1"]), ("Extra_Low", "TRUE", ["p2"]),
    ), PARAMS)
_MED = "Actual_IndividualIntervention_Config__KP_Medium_Risk_"
ORACLE["param_map_county"] = with_(
    entries(
        ("Initial_Distribution__KP_Risk_Homa_Bay", "TRUE", ["p3", "1 - p3", "0"]),
        ("Initial_Distribution__KP_Risk_Kisii", "TRUE", ["p2", "1 - p2", "0"]),
        *[(f"{_MED}{c}.Ramp_Max", "p2 > 0", ["p2"]) for c in ("Homa_Bay", "Kisii", "Kisumu", "Migori", "Nyamira", "Siaya")],
    ), PARAMS)
ORACLE["param_unmapped"] = with_(
    "SELECT DISTINCT 'ProbExtraTransitoryMaleMedium' AS parameter FROM params", PARAMS)
ORACLE["param_seed"] = with_(
    "SELECT parameterization_id, CAST(('0x' || md5('7:' || parameterization_id)[1:4]) AS INT) AS run_seed FROM params", PARAMS)
ORACLE["config_override"] = with_(
    """SELECT parameterization_id, parameter AS key, CASE WHEN parameterization_id % 5 = 0 OR parameter = 'p3' THEN '"base"'
 WHEN value > 0.5 THEN CAST(CAST(round(value, 6) AS DECIMAL(18,6)) AS VARCHAR) WHEN value > 0 THEN '["a","b"]'
 WHEN value < -0.5 THEN '"text"' END AS value FROM long
UNION ALL SELECT parameterization_id, 'added', '[1,2]' FROM params WHERE parameterization_id % 7 = 0""", PARAMS, LONG)
_SIX = "CAST(CAST(floor({} * 1e6) AS BIGINT) AS VARCHAR)"
_BASE_MAX = ", ".join(f"(SELECT {_SIX.format(f'MAX(p{i})')} FROM params) AS b{i}" for i in range(4))
ORACLE["config_documents"] = with_(
    f"""SELECT parameterization_id, '{{"p3":' || b3 || ',"parameters":{{"Empty":{{' || CASE WHEN even THEN '"Added":"' || source || '"' ELSE '' END
 || '}},"Name":' || CASE WHEN parameterization_id % 5 = 0 THEN '"fifth"' ELSE 'null' END || ',"Rates":{{"Deep":{{'
 || CASE WHEN parameterization_id % 7 = 0 THEN '"Only":' || {_SIX.format('p1')}
  ELSE '"Years":[1990,2000],"p2":' || CASE WHEN even THEN {_SIX.format('p2')} ELSE b2 END END
 || '}},"p0":' || CASE WHEN parameterization_id % 5 <> 0 THEN {_SIX.format('p0')} ELSE b0 END || ',"p1":' || b1 || '}}}}}}' AS config
FROM (SELECT *, parameterization_id % 2 = 0 AS even, {_BASE_MAX} FROM params)""", PARAMS)
ORACLE["select_params"] = with_(
    f"""SELECT CAST(250 + row_number() OVER (ORDER BY parameterization_id) AS BIGINT) AS parameterization_id, {", ".join(P)}
FROM params WHERE parameterization_id IN (SELECT run_num FROM ({_BEST.format(5)}))
UNION ALL SELECT parameterization_id + 1000, {", ".join(P)} FROM params WHERE parameterization_id >= 8""", REPORT, STD, FIT, PARAMS)
ORACLE["top_likelihood"] = with_("SELECT * FROM params ORDER BY likelihood DESC, parameterization_id LIMIT 100", PARAMS)
ORACLE["roulette_sample"] = with_(
    """SELECT CAST(row_number() OVER (ORDER BY stage, k, source_id) - 1 AS INT) AS parameterization_id, source_id,
 CASE stage WHEN 0 THEN 'top' ELSE 'roulette' END AS selected_by, likelihood
FROM (SELECT parameterization_id AS source_id, 0 AS stage, -likelihood AS k, likelihood FROM ranked WHERE r <= 100
 UNION ALL (SELECT parameterization_id, 1, -ln(u) / (likelihood / SUM(likelihood) OVER ()) AS k, likelihood FROM rest
  ORDER BY k, parameterization_id LIMIT 200))""",
    PARAMS,
    """ranked AS (SELECT *, row_number() OVER (ORDER BY likelihood DESC, parameterization_id) AS r, COUNT(*) OVER () AS n FROM params),
rest AS (SELECT *, (CAST('0x' || md5('11:' || parameterization_id)[1:13] AS BIGINT)::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
 FROM ranked WHERE r > 100 AND r < n)""")
SCEN = """scen AS (SELECT 'PrEP-' || k * 10 AS "Scenario", CASE WHEN k % 5 = 4 THEN NULL WHEN k = 7 THEN 'campaign_unknown.json'
 ELSE 'campaign_' || k % 3 || '.json' END AS "Campaign", CAST(k % 4 * 0.25::DOUBLE AS VARCHAR) AS p1
FROM (SELECT DISTINCT c_nationkey AS k FROM customer))"""
ORACLE["scenario_table"] = with_("SELECT * FROM scen", SCEN)
ORACLE["scenario_expand"] = with_(
    f"""SELECT parameterization_id, {", ".join(p for p in P if p != "p1")}, parameterization_id % 5 AS run_number, template_set, campaign_file,
 template_set || '-' || COALESCE(replace("Campaign", '.json', ''), 'Default_Campaign') || '-' || "Scenario" AS scenario,
 CAST(s.p1 AS DOUBLE) AS p1,
 template_set || '-' || COALESCE(replace("Campaign", '.json', ''), 'Default_Campaign') || '-' || "Scenario" AS config_name
FROM params, (SELECT *, 'Baseline' AS template_set, "Campaign" AS campaign_file FROM scen WHERE "Campaign" <> 'campaign_unknown.json'
 UNION ALL SELECT *, 'Single', 'campaign_0.json' FROM scen WHERE "Campaign" IS NULL OR "Campaign" = 'campaign_0.json') s""", PARAMS, SCEN)
ORACLE["overlay_explode"] = """
SELECT CAST(c_custkey AS INT) AS node_id, 'Node_' || c_nationkey AS node_name, property, value, share FROM (
 SELECT c_custkey, c_nationkey, 'Risk' AS property, unnest(['LOW', 'MEDIUM', 'HIGH']) AS value,
  unnest([c_custkey % 4 / 4::DOUBLE, 1 - c_custkey % 4 / 4::DOUBLE, 0::DOUBLE]) AS share FROM customer
 UNION ALL SELECT c_custkey, c_nationkey, 'Accessibility', unnest(['Yes', 'No']), unnest([1::DOUBLE, 0::DOUBLE]) FROM customer)"""
