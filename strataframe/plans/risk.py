"""Extinction risk of the two sides and their contrast.

The hierarchical models are not sampled here. Observed risks and fixed-effect
logistic fits replace them; neither has priors or partial pooling, and their
numbers are no posteriors. Posterior draws made elsewhere are accepted as tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strataframe.operators.aggregates import counts
from strataframe.operators.draws import (
    MEDIAN_QI, bound_contrast, contrast_draws, summarise_draws, with_group_mean,
)
from strataframe.operators.joins import expand_levels
from strataframe.operators.regression import logistic_fit, treatment_terms
from strataframe.operators.reshape import pivot_values
from strataframe.plans.stages import BASELINE, LARGE
from strataframe.sources.dimensions import Intervals, small_table

SIDES = (BASELINE, LARGE)


def observed_risk(signal: DataFrame, keys=("group", "group_id")) -> DataFrame:
    """Share of taxon-stage rows that end in extinction."""
    return signal.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("ext_signal").alias("extinctions"),
        F.avg("ext_signal").alias("risk"),
    )


def observed_contrast(signal: DataFrame) -> DataFrame:
    wide = pivot_values(observed_risk(signal), ["group"], "group_id", SIDES, {"risk": F.max("risk")})
    return wide.withColumn("risk_diff", F.col("risk_baseline") - F.col("risk_megafauna"))


def prediction_grid(signal: DataFrame) -> DataFrame:
    """Every group with both sides."""
    return expand_levels(signal.select("group").distinct(), "group_id", SIDES)


def risk_model(signal: DataFrame) -> DataFrame:
    """Logistic fit of the signal on side, group and their interaction."""
    cells = small_table(counts(signal, ["group", "group_id", "ext_signal"], "n"))
    side = (F.col("group_id") == LARGE).cast("double")
    groups = treatment_terms(cells, "group")
    terms = [(LARGE, side), *groups, *[(f"{LARGE}:{n}", side * c) for n, c in groups]]
    return logistic_fit(cells, "ext_signal", "n", terms)


def risk_model_through_time(signal: DataFrame) -> DataFrame:
    """Logistic fit with a slope over stages for each side and group."""
    cells = small_table(counts(signal, ["group", "group_id", "bin_occ", "ext_signal"], "n"))
    stage = F.col("bin_occ").cast("double")
    sides = {s: (F.col("group_id") == s).cast("double") * stage for s in SIDES}
    groups = treatment_terms(cells, "group")
    terms = [*groups, *[(f"{s}:bin_occ", c) for s, c in sides.items()]]
    terms += [(f"{n}:{s}:bin_occ", c * g) for n, g in groups for s, c in sides.items()]
    return logistic_fit(cells, "ext_signal", "n", terms)


def risk_from_draws(draws: DataFrame) -> DataFrame:
    """Median and bounds per group and side, then their differences.

    ``risk_diff_low`` and ``risk_diff_high`` subtract interval ends and are not an
    interval of the difference; ``contrast_draws`` gives one.
    """
    summary = summarise_draws(draws, "epred", ["group", "group_id"], MEDIAN_QI)
    return bound_contrast(
        summary, ["group"], "group_id", *SIDES,
        {"median": "risk_diff", "lower": "risk_diff_low", "upper": "risk_diff_high"},
    )


def _logit_contrast(draws: DataFrame) -> DataFrame:
    return contrast_draws(draws, "linpred", ["group", "bin_occ"], "group_id", *SIDES, out="logit")


def logit_summary(draws: DataFrame) -> DataFrame:
    """Median and bounds of the draw-wise contrast per group and stage."""
    return summarise_draws(_logit_contrast(draws), "logit", ["group", "bin_occ"], MEDIAN_QI)


def logit_through_time(draws: DataFrame, intervals: Intervals) -> DataFrame:
    """Draw-wise contrast per group and stage, with its mean and the stage midpoint."""
    averaged = with_group_mean(_logit_contrast(draws), "logit", ["group", "bin_occ"], "mean_logit")
    age = intervals.dimension(draws.sparkSession, F.col("stg").alias("bin_occ"), F.col("mid").alias("age"))
    return averaged.join(age, "bin_occ", "left").withColumnRenamed("draw", ".draw")
