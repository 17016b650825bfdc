"""Labels, age bins and names derived from codes and strings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalens.sources.schema import AGE_UPPER, COUNTIES, SURVEY_YEARS


def lookup(key: Column, table: dict, otherwise: Column | None = None) -> Column:
    """A ``CASE`` chain over a small fixed table."""
    first, *rest = table.items()
    start = F.when(key == first[0], F.lit(first[1]))
    chain = reduce(lambda c, kv: c.when(key == kv[0], F.lit(kv[1])), rest, start)
    return chain if otherwise is None else chain.otherwise(otherwise)


def county_name(node_id: Column) -> Column:
    return lookup(node_id, COUNTIES)


def gender_from_code(code: Column) -> Column:
    return F.when(code == 0, F.lit("Men")).otherwise(F.lit("Women"))


def gender_code_from_letter(letter: Column) -> Column:
    return lookup(letter, {"M": 0, "F": 1, "Both": 2})


def gender_code_from_name(name: Column) -> Column:
    return lookup(name, {"Male": 0, "Female": 1, "Both": 2})


def gender_name_from_code(code: Column) -> Column:
    return lookup(code, {0: "Male", 1: "Female", 2: "Both"})


def gender_from_survey(name: Column) -> Column:
    """Survey spelling to model spelling; any other text is kept."""
    return lookup(name, {"Female": "Women", "Male": "Men"}, name)


def gender_two_way(name: Column) -> Column:
    """``Male`` is men, all else women."""
    return F.when(name == "Male", F.lit("Men")).otherwise(F.lit("Women"))


def age_upper(lower: Column, binning: str) -> Column:
    return lookup(lower, AGE_UPPER[binning], (lower + 5).cast("int")).cast("int")


def adult_split(lower: Column) -> tuple[Column, Column]:
    """Both bounds of the under 15 / 15 and over split, from the original lower bound."""
    adult = lower >= 15
    return (
        F.when(adult, F.lit(15)).otherwise(F.lit(0)),
        F.when(adult, F.lit(100)).otherwise(F.lit(15)),
    )


def risk_label(risk: Column) -> Column:
    return F.initcap(F.lower(risk))


def sort_key(value: Column, levels: tuple[str, ...]) -> Column:
    """Position of a label in an ordered list of levels, NULL when absent."""
    position = F.array_position(F.array(*[F.lit(v) for v in levels]), value)
    return F.nullif(position, F.lit(0).cast("bigint")).cast("int")


def age_bin_bound(text: Column, which: int) -> Column:
    """Lower (1) or upper (2) bound of a bin written ``[a:b)``."""
    bound = F.regexp_extract(text, r"^\[(\d+):(\d+)\)$", which)
    return bound.try_cast("int")


def age_bin_text(lower: Column, upper: Column) -> Column:
    return F.format_string("[%d:%d)", lower, upper)


def age_label(lower: Column, upper: Column) -> Column:
    """Closed range for display; the first bin is always shown as ``0-1``."""
    span = F.concat_ws("-", lower.cast("string"), (upper - 1).cast("string"))
    return F.when(lower == 0, F.lit("0-1")).otherwise(span)


def scenario_coverage(name: Column) -> Column:
    """The number after the last dash of a scenario name."""
    return F.element_at(F.split(name, "-"), -1).try_cast("int")


def scenario_method(name: Column) -> Column:
    return F.when(name.contains("6mo"), F.lit("Const_180")).otherwise(F.lit("Const_90"))


def survey_source(year: Column) -> Column:
    pairs = [(year.isin(*years), label) for label, years in SURVEY_YEARS.items()]
    first, *rest = pairs
    start = F.when(first[0], F.lit(first[1]))
    return reduce(lambda c, p: c.when(p[0], F.lit(p[1])), rest, start)


def run_source(run_num: Column, boundary: int = 250) -> Column:
    return F.when(run_num > boundary, F.lit("AB")).otherwise(F.lit("KP"))


def strip_parameter_prefix(name: Column) -> Column:
    return F.regexp_replace(name, r"CONFIG\.|DEMOGRAPHICS\.|CAMPAIGN\.", "")


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")


def list_or_null(text: Column, element: str = "double") -> Column:
    """An array from text such as ``[1,2,3]``, of any element type, lists included.

    Other text is not a list and gives NULL; text that begins as a list and cannot be
    read as one of this type fails.
    """
    begins = F.ltrim(text).startswith("[")
    return F.when(begins, F.from_json(text, f"array<{element}>", {"mode": "FAILFAST"}))


def list_or_scalar(text: Column) -> Column:
    """The value that a text stands for: a list of any depth, a number, or else the text itself, as a variant."""
    begins = F.ltrim(text).startswith("[")
    plain = F.parse_json(F.concat(F.lit('"'), F.regexp_replace(text, r'(["\\\\])', r"\\$1"), F.lit('"')))
    return F.when(begins, F.parse_json(text)).otherwise(F.coalesce(F.try_parse_json(text), plain))
