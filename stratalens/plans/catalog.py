"""The named measures: what each output filters, groups by and divides."""

from __future__ import annotations

from stratalens.operators.measures import MeasureSpec

YEAR = {"year": "year"}
CALENDAR = {"year": "year_floor"}
GENDER = {"gender": "gender"}
COUNTY = {"county": "county"}
RISK = {"risk": "risk"}
AGES = {"age_lower": "age_lower", "age_upper": "age_upper"}
SPLIT_AGES = {
    "age_lower": "CASE WHEN age_lower >= 15 THEN 15 ELSE 0 END",
    "age_upper": "CASE WHEN age_lower >= 15 THEN 100 ELSE 15 END",
}
CIRCUMCISED = "CASE WHEN circ = 1 THEN population ELSE 0 END"


def bin_inside(low: int, high: int, strict: bool = False) -> str:
    """Bins that lie inside a range; ``strict`` leaves out a bin that ends on its edge."""
    return f"age_lower >= {low} AND age_upper {'<' if strict else '<='} {high}"


def both(*conditions: str | None) -> str | None:
    kept = [c for c in conditions if c]
    return " AND ".join(f"({c})" for c in kept) if kept else None


def span(low: int, high: int) -> dict[str, int]:
    return {"age_lower": low, "age_upper": high}


def circumcision(low: int = 15, high: int = 50, oldest: int = 55) -> list[MeasureSpec]:
    men = "gender = 'Men'"
    adult = both(men, bin_inside(low, high))
    fixed = {**span(low, high), "gender": "Men"}

    def spec(output, dims, where, labels):
        return MeasureSpec(
            output, "Circumcision", dims, CIRCUMCISED, "population", "ratio", where, labels
        )

    return [
        spec("circ", YEAR, adult, fixed),
        spec("circ_age", {**YEAR, **AGES}, both(men, f"age_lower <= {oldest}"), {"gender": "Men"}),
        spec("circ_county", {**YEAR, **COUNTY}, adult, fixed),
    ]


def population(known_ages: str | None = None) -> list[MeasureSpec]:
    """``known_ages`` limits the outputs by age to the bins the survey has."""

    def spec(output, dims, where=None):
        return MeasureSpec(output, "Population", {**YEAR, **dims}, "population", None, "sum", where)

    return [
        spec("pop", {}),
        spec("pop_age", AGES, known_ages),
        spec("pop_county", COUNTY),
        spec("pop_county_age", {**COUNTY, **AGES}, known_ages),
        spec("pop_county_gender_age", {**COUNTY, **GENDER, **AGES}, known_ages),
    ]


def treatment(adult: int = 15) -> list[MeasureSpec]:
    def count(output, dims, where=None, labels=None):
        return MeasureSpec(
            output, "ART", {**YEAR, **dims}, "on_art", None, "sum", where, labels or {}
        )

    def share(output, dims, where=None, labels=None):
        return MeasureSpec(
            output, "ART Proportion", {**YEAR, **dims}, "on_art", "infected", "ratio0", where,
            labels or {},
        )

    return [
        count("art", {}, bin_inside(adult, 100), span(adult, 100)),
        count("art_gender_age", {**GENDER, **SPLIT_AGES}),
        count("art_county_gender_age", {**COUNTY, **GENDER, **SPLIT_AGES}),
        share("art_prev", {}),
        share("art_prev_gender", GENDER),
        share("art_prev_gender_adults", GENDER, f"age_lower >= {adult}", span(adult, 100)),
        share("art_prev_gender_county", {**GENDER, **COUNTY}),
    ]


def prevalence(
    low: int = 15, high: int = 50, period: tuple[float, float] = (2018, 2020), oldest: int = 65
) -> list[MeasureSpec]:
    adult = bin_inside(low, high)
    pooled = both(f"year >= {period[0]} AND year < {period[1]}", bin_inside(low, oldest))

    def spec(output, dims, where, labels):
        return MeasureSpec(
            output, "Prevalence", dims, "infected", "population", "ratio", where, labels
        )

    return [
        spec("prev", YEAR, adult, span(low, high)),
        spec("prev_val", {}, pooled, {**span(low, oldest), "year": period[0] + 0.5}),
        spec("prev_gender", {**YEAR, **GENDER}, adult, span(low, high)),
        spec(
            "prev_gender_age", {**YEAR, **GENDER, **AGES},
            f"age_lower >= {low} AND age_lower <= {high}", {},
        ),
        spec("prev_county_gender", {**YEAR, **COUNTY, **GENDER}, adult, span(low, high)),
    ]


def calibration_measures(known_ages: str | None = None) -> list[MeasureSpec]:
    """The outputs of a calibration report that has no risk strata."""
    return [*population(known_ages), *treatment(), *prevalence(), *circumcision()]


def incidence(output, dims, where=None, labels=None) -> MeasureSpec:
    """New infections per 100 person-years."""
    return MeasureSpec(
        output, "Incidence", dims, "newly_infected", "person_years", "rate100", where, labels or {}
    )


def women_trial(
    ages: tuple[int, int] = (16, 36),
    shown: tuple[int, int] = (16, 35),
    years: tuple[int, int] = (2010, 2020),
    pooled: tuple[int, int] = (2016, 2017),
) -> list[MeasureSpec]:
    """Incidence among women of trial age, by year and pooled, with and without high risk."""
    women = both("gender = 'Women'", bin_inside(*ages))
    yearly = both(women, f"year_floor >= {years[0]} AND year_floor <= {years[1]}")
    pool = both(women, f"year_floor >= {pooled[0]} AND year_floor <= {pooled[1]}")
    lower_risk = "risk <> 'HIGH'"
    tag = {**span(*shown), "source": "ECHO"}
    middle = {**tag, "year": pooled[0] + 0.5}
    by_year = {**CALENDAR, **GENDER}
    return [
        incidence("inc_echo_year_risk", {**by_year, **RISK}, yearly, tag),
        incidence("inc_echo_year", by_year, yearly, tag),
        incidence(
            "inc_echo_year_low_med", by_year, both(yearly, lower_risk),
            {**tag, "risk": "LOW+MEDIUM"},
        ),
        incidence("inc_echo", GENDER, pool, middle),
        incidence(
            "inc_echo_low_med", GENDER, both(pool, lower_risk), {**middle, "risk": "LOW+MEDIUM"}
        ),
    ]


def women_by_risk(
    trial: str, ages: tuple[int, int], shown: tuple[int, int], first_year: int
) -> list[MeasureSpec]:
    """Yearly incidence of a trial's age range, by risk and overall (end-of-interval)."""
    where = both(
        "gender = 'Women'", bin_inside(*ages, strict=True), f"year_floor >= {first_year}"
    )
    tag = {**span(*shown), "source": trial}
    name = f"inc_{trial.lower()}"
    by_year = {**CALENDAR, **GENDER}
    return [
        incidence(f"{name}_risk", {**by_year, **RISK}, where, tag),
        incidence(name, by_year, where, tag),
    ]


def sweep_measures(
    ages: tuple[int, int] = (16, 36),
    shown: tuple[int, int] = (16, 35),
    period: tuple[int, int] = (2022, 2032),
) -> list[MeasureSpec]:
    """Incidence, new infections and coverage of one scenario of a sweep."""
    women = "gender = 'Women'"
    trial = both(women, bin_inside(*ages))
    inside = f"year_floor >= {period[0]} AND year_floor <= {period[1]}"
    label = f"{period[0]}-{period[1]}"
    everyone = {**span(0, 105), "gender": "All"}
    trial_age = span(*shown)

    def new(output, where, labels):
        return MeasureSpec(
            output, "New Infections", CALENDAR, "newly_infected", None, "sum", where, labels
        )

    return [
        incidence("inc", CALENDAR, None, everyone),
        incidence(f"inc_{period[0]}_{period[1]}", {}, inside, {**everyone, "period": label}),
        incidence("inc_women", {**CALENDAR, **GENDER}, women, span(0, 105)),
        incidence("inc_echo", {**CALENDAR, **GENDER}, trial, trial_age),
        incidence(
            f"inc_echo_{period[0]}_{period[1]}", GENDER, both(trial, inside),
            {**trial_age, "period": label},
        ),
        new("new_inf", None, everyone),
        new("new_inf_women", women, {**span(0, 105), "gender": "Women"}),
        new("new_inf_echo", trial, {**trial_age, "gender": "Women"}),
        coverage("prep_echo", {"year": "floor(year)"}, trial, {**trial_age, "gender": "Women"}),
    ]


def coverage(output, dims, where, labels, form: str = "ratio") -> MeasureSpec:
    """Share of the uninfected who hold the intervention."""
    return MeasureSpec(
        output, "PrEP Coverage", dims, "has_prep", "population - infected", form, where, labels
    )


def method_measures(
    ages: tuple[int, int] = (16, 36),
    shown: tuple[int, int] = (16, 35),
    years: tuple[int, int] = (2020, 2030),
) -> list[MeasureSpec]:
    """Comparison of methods: incidence years count from the interval start, coverage
    years from the report time."""
    trial = both("gender = 'Women'", bin_inside(*ages))
    labels = span(*shown)
    return [
        incidence(
            "inc_echo", {**CALENDAR, **GENDER},
            both(trial, f"year_floor >= {years[0]} AND year_floor <= {years[1]}"), labels,
        ),
        coverage(
            "prep_echo", {"year": "floor(year)"},
            both(trial, f"floor(year) >= {years[0]} AND floor(year) <= {years[1]}"),
            {**labels, "gender": "Women"},
        ),
    ]


def dormant_measures(interval: float) -> list[MeasureSpec]:
    """Outputs that are defined but switched off in normal use."""
    on_method = (
        f"has_prep * {interval!r}D + prep_expired * {interval!r}D / 2"
        f" + prep_aborted * {interval!r}D / 2"
    )
    by_risk = {**GENDER, **RISK}
    return [
        MeasureSpec("prep_persontime_gender_risk", "PrEP Person-Years", by_risk, on_method, None, "sum"),
        MeasureSpec(
            "new_infections_gender_risk", "New Infections", by_risk, "newly_infected", None, "sum"
        ),
    ]


def suppressed_share(condition: str) -> MeasureSpec:
    """Share of those on treatment for whom ``condition`` holds."""
    return MeasureSpec(
        "prop_suppressed_gender", "Suppressed Proportion", {**YEAR, **GENDER},
        f"CASE WHEN {condition} THEN on_art ELSE 0 END", "on_art", "ratio0",
    )
