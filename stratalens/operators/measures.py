"""Measures declared as data: a filter, group keys and two sums.

Each measure is ``filter -> sum a numerator and a denominator -> one closing
formula``. One measure can be evaluated by itself, and any number of them in a
single pass over the strata.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.functions.ratios import rate100, ratio, ratio0
from stratalens.sources.schema import DIMENSIONS, MEASURE_COLUMNS, run_keys_of

# Closing formulas over the two sums.
FORMS = {
    "sum": lambda num, den: num,
    "ratio": ratio,
    "ratio0": ratio0,
    "percent": rate100,
    "rate100": rate100,
}

DEFAULTS = {
    "year": None,
    "period": None,
    "county": "All",
    "gender": "Both",
    "age_lower": 0,
    "age_upper": 100,
    "risk": "All",
    "source": None,
}


@dataclass(frozen=True)
class MeasureSpec:
    """One named output.

    ``dims`` maps a result dimension to the SQL expression it is grouped by;
    ``labels`` gives the constant of a dimension that is not grouped. Dimensions in
    neither take the value for "all".
    """

    output: str
    measure: str
    dims: dict[str, str]
    num: str
    den: str | None = None
    form: str = "ratio"
    where: str | None = None
    labels: dict[str, object] = field(default_factory=dict)

    def __post_init__(self):
        if self.form not in FORMS:
            raise ValueError(f"{self.output}: unknown form {self.form!r}")
        unknown = (set(self.dims) | set(self.labels)) - set(DIMENSIONS)
        if unknown:
            raise ValueError(f"{self.output}: unknown dimensions {sorted(unknown)}")

    def dimension(self, name: str, type_: str) -> Column:
        if name == "measure":
            return F.lit(self.measure)
        if name in self.dims:
            return F.expr(self.dims[name]).cast(type_)
        return F.lit(self.labels.get(name, DEFAULTS[name])).cast(type_)

    def names(self) -> set[str]:
        """Every identifier the measure mentions, columns among them."""
        texts = [*self.dims.values(), self.num, self.den or "", self.where or ""]
        return set(re.findall(r"[A-Za-z_]\w*", " ".join(texts)))

    def sums(self) -> tuple[Column, Column]:
        den = F.expr(self.den) if self.den else F.lit(None)
        return F.expr(self.num).cast("double"), den.cast("double")


def evaluate(
    df: DataFrame, spec: MeasureSpec, run_keys: Sequence[str] | None = None
) -> DataFrame:
    """Long rows of one measure, one per run and group."""
    run_keys = run_keys_of(df, run_keys)
    rows = df.where(spec.where) if spec.where else df
    grouped = {n: t for n, t in MEASURE_COLUMNS if n in spec.dims}
    num, den = spec.sums()
    sums = (
        rows.select(
            *run_keys,
            *[spec.dimension(n, t).alias(n) for n, t in grouped.items()],
            num.alias("_num"),
            den.alias("_den"),
        )
        .groupBy(*run_keys, *grouped)
        .agg(F.sum("_num").alias("_num"), F.sum("_den").alias("_den"))
    )
    value = FORMS[spec.form](F.col("_num"), F.col("_den"))
    columns = [
        (F.col(n) if n in grouped else spec.dimension(n, t)).alias(n)
        for n, t in MEASURE_COLUMNS
        if n != "value"
    ]
    return sums.select(*run_keys, *columns, value.cast("double").alias("value"))


def evaluate_all(
    df: DataFrame, specs: Iterable[MeasureSpec], run_keys: Sequence[str] | None = None
) -> DataFrame:
    """Every measure from one pass: long rows with an ``output`` column.

    Each stratum row is tagged with the outputs it counts towards and all sums are
    taken by one aggregation, so twenty outputs cost one shuffle, not twenty. Give
    it strata that are already summed (``finest_strata``), not raw rows.
    """
    specs = list(specs)
    run_keys = run_keys_of(df, run_keys)
    every = range(len(specs))
    types = dict(MEASURE_COLUMNS)
    grouped = [n for n in DIMENSIONS if any(n in s.dims for s in specs)]
    hits = [F.when(F.expr(s.where), F.lit(i)) if s.where else F.lit(i) for i, s in enumerate(specs)]
    tagged = df.withColumn("_id", F.explode(F.array_compact(F.array(*hits))))

    def per_output(texts: Iterable[str | None], build, type_: str) -> Column:
        """A column that differs by output; outputs that share it share one branch."""
        owners: dict[object, list[int]] = {}
        for i, text in enumerate(texts):
            if text is not None:
                owners.setdefault(text, []).append(i)
        if len(owners) == 1 and len(*owners.values()) == len(specs):
            return build(*owners).cast(type_)
        chain = F.lit(None).cast(type_)
        for text, ids in owners.items():
            chain = F.when(F.col("_id").isin(*ids), build(text).cast(type_)).otherwise(chain)
        return chain

    sums = (
        tagged.select(
            *run_keys,
            "_id",
            *[per_output([s.dims.get(n) for s in specs], F.expr, types[n]).alias(n) for n in grouped],
            per_output([s.num for s in specs], F.expr, "double").alias("_num"),
            per_output([s.den for s in specs], F.expr, "double").alias("_den"),
        )
        .groupBy(*run_keys, "_id", *grouped)
        .agg(F.sum("_num").alias("_num"), F.sum("_den").alias("_den"))
    )

    def dimension(name: str) -> Column:
        if name == "measure":
            return per_output([s.measure for s in specs], F.lit, "string")
        labels = [None if name in s.dims else s.labels.get(name, DEFAULTS[name]) for s in specs]
        fixed = per_output(labels, F.lit, types[name])
        own = [i for i in every if name in specs[i].dims]
        return F.when(F.col("_id").isin(*own), F.col(name)).otherwise(fixed) if own else fixed

    value = per_output(
        [s.form for s in specs], lambda f: FORMS[f](F.col("_num"), F.col("_den")), "double"
    )
    return sums.select(
        *run_keys,
        per_output([s.output for s in specs], F.lit, "string").alias("output"),
        *[dimension(n).alias(n) for n in DIMENSIONS],
        value.alias("value"),
    )
