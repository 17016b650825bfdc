"""The list of runs to make: template sets x scenarios x parameter samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.functions.recode import file_stem

DEFAULT_CAMPAIGN = "Default_Campaign"


def resolve_campaigns(scenarios: DataFrame, templates: Mapping[str, Sequence[str]]) -> DataFrame:
    """Template set x scenario with the campaign each pair uses, and what is wrong with it.

    A scenario without a campaign takes the only one of the template set.
    """
    entries = [
        F.struct(
            F.lit(name).alias("template_set"),
            F.array(*[F.lit(c) for c in campaigns]).cast("array<string>").alias("_known"),
        )
        for name, campaigns in templates.items()
    ]
    named = F.col("Campaign").isNotNull()
    only = F.when(F.size("_known") == 1, F.get("_known", F.lit(0)))
    known = F.array_contains("_known", F.col("Campaign"))
    problem = F.when(named & ~known, F.lit("unknown campaign")).when(
        ~named & (F.size("_known") != 1), F.lit("not exactly one campaign")
    )
    return scenarios.select("*", F.inline(F.array(*entries))).withColumns(
        {
            "campaign_file": F.when(named, F.when(known, F.col("Campaign"))).otherwise(only),
            "problem": problem,
        }
    ).drop("_known")


def scenario_title(template_set: Column, campaign: Column, scenario: Column) -> Column:
    """``template-campaign-scenario``; ``concat_ws`` leaves out a missing scenario."""
    stem = F.coalesce(file_stem(campaign), F.lit(DEFAULT_CAMPAIGN))
    return F.concat_ws("-", template_set, stem, scenario)


def expand_runs(samples: DataFrame, resolved: DataFrame, strict: bool = True) -> DataFrame:
    """One row per template set, scenario and sample.

    Every sample meets every resolved scenario by a join on one common document, whose
    smaller side the optimizer sends to the tasks if it is small enough. Columns of
    the scenario table override equal sample columns. With ``strict`` the job
    fails on a scenario whose campaign cannot be resolved, else it is left out.
    """
    if strict:
        wrong = F.raise_error(F.col("problem")).cast("string")
        resolved = resolved.withColumn("template_set", F.when(F.col("problem").isNotNull(), wrong).otherwise(F.col("template_set")))
    else:
        resolved = resolved.where(F.col("problem").isNull())
    used = ("Scenario", "Campaign", "template_set", "campaign_file", "problem")
    extra = [c for c in resolved.columns if c not in used]
    title = scenario_title(F.col("template_set"), F.col("Campaign"), F.col("Scenario"))
    scenarios = resolved.select(
        F.lit(0).alias("_document"), "template_set", "campaign_file", title.alias("scenario"), *extra
    )
    kept = [c for c in samples.columns if c not in extra]
    return (
        samples.select(F.lit(0).alias("_document"), *kept)
        .join(scenarios, "_document")
        .drop("_document")
        .withColumn("config_name", F.col("scenario"))
    )
