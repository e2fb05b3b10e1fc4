"""Least squares per group in one aggregation pass, and binomial GLMs on counts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, GroupedData, Row, functions as F, types as T

from strataframe.functions.numeric import normal_p_value, percent_change, t_critical, t_p_value
from strataframe.functions.text import interval_text, percent_text
from strataframe.sources.dimensions import literal_table, take_dimension


def least_squares(df: DataFrame, y: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Slope, intercept, standard error, t and residual degrees of freedom per key.

    Built on the mergeable ``regr_*`` moments, so a hot group is reduced map-side.
    A group without residual degrees of freedom keeps its slope but has no error.
    """
    return _slopes(df.groupBy(*by), y, x)


def _slopes(grouped: GroupedData, y: str, x: str, *extra: Column) -> DataFrame:
    yc, xc = F.col(y), F.col(x)
    moments = grouped.agg(
        F.regr_count(yc, xc).alias("n"),
        F.regr_slope(yc, xc).alias("slope"),
        F.regr_intercept(yc, xc).alias("intercept"),
        F.regr_sxx(yc, xc).alias("__sxx"),
        F.regr_syy(yc, xc).alias("__syy"),
        F.regr_sxy(yc, xc).alias("__sxy"),
        *extra,
    )
    dof = F.col("n") - 2
    rss = F.greatest(F.col("__syy") - F.col("__sxy") * F.col("__sxy") / F.col("__sxx"), F.lit(0.0))
    se = F.when((dof > 0) & (F.col("__sxx") > 0), F.sqrt(rss / dof / F.col("__sxx")))
    return (
        moments.withColumn("dof", dof)
        .withColumn("se", se)
        .withColumn("t", F.try_divide("slope", "se"))
        .drop("__sxx", "__syy", "__sxy")
    )


def with_inference(fits: DataFrame, *, level: float = 0.95) -> DataFrame:
    """Add p-value and slope confidence bounds to one row per group."""
    margin = t_critical(1 - level, F.col("dof")) * F.col("se")
    return (
        fits.withColumn("p_value", t_p_value(F.col("t"), F.col("dof")))
        .withColumn("__m", margin)
        .withColumn("lower", F.col("slope") - F.col("__m"))
        .withColumn("upper", F.col("slope") + F.col("__m"))
        .drop("__m")
    )


def stars(p: Column, *, as_published: bool = False) -> Column:
    """Significance stars. The published rule tests 0.01 < p <= 0.05 with reversed
    bounds, which never holds, so such p-values stay null there."""
    one_star = p.between(0.05, 0.01) if as_published else p.between(0.01, 0.05)
    return (
        F.when(p > 0.05, "ns")
        .when(p.between(0.001, 0.01), "**")
        .when(one_star, "*")
        .when(p < 0.001, "***")
    )


def trend_table(
    df: DataFrame, y: str, x: str, group: str, *, overall: str = "Overall", per: float = 10.0,
    as_published: bool = False,
) -> DataFrame:
    """Slopes of a log response as percent change per ``per`` units, one row per group and
    one pooled. The factor is applied linearly, not compounded."""
    # A rollup gives the groups and the pooled fit from one scan.
    both = _slopes(df.rollup(group), y, x, F.grouping(group).alias("__pooled"))
    named = both.withColumn(group, F.when(F.col("__pooled") == 1, overall).otherwise(F.col(group)))
    fits = with_inference(named.drop("__pooled"))
    scaled = lambda c: percent_change(F.col(c)) * per
    star = stars(F.col("p_value"), as_published=as_published)
    if as_published:
        star = F.when(F.col(group) == overall, "***").otherwise(star)
    return fits.select(
        group,
        percent_text(scaled("slope")).alias("mean_trend"),
        star.alias("p_star"),
        interval_text(scaled("lower"), scaled("upper")).alias("CI"),
    )


def fitted_ends(df: DataFrame, y: str, x: str, by: Sequence[str]) -> DataFrame:
    """End points of the fitted line over each group's own x range."""
    fits = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(
        F.regr_slope(F.col(y), F.col(x)).alias("__b"),
        F.regr_intercept(F.col(y), F.col(x)).alias("__a"),
        F.min(x).alias("__lo"),
        F.max(x).alias("__hi"),
    )
    ends = fits.withColumn("x", F.explode(F.array("__lo", "__hi")))
    return ends.select(*by, "x", (F.col("__a") + F.col("__b") * F.col("x")).alias("fitted"))


_COEFFICIENTS = T.StructType([
    T.StructField("term", T.StringType()),
    T.StructField("estimate", T.DoubleType()),
    T.StructField("se", T.DoubleType()),
])

INTERCEPT = "(Intercept)"
#: Newton passes of a penalised fit, and the step at which it counts as converged.
MAX_PASSES, STEP = 100, 1e-9


class ConstantResponse(ValueError):
    """The response takes one value only: there is nothing to test."""


def logistic_fit(
    cells: DataFrame, response: str, weight: str, terms: Sequence[tuple[str, Column]]
) -> DataFrame:
    """Wald table of a binomial GLM with an intercept and the given numeric terms.

    ``cells`` are counted covariate patterns, ``weight`` their row counts: the
    likelihood only needs those, so the fit iterates over a tiny table whatever
    the number of raw rows. Cells that lack the response or a term are left out.

    ``fit`` says how a row came about. ``likelihood`` is the maximum. Where a term alone splits
    the responses, or the maximum is not reached, it does not exist (an estimate would grow for ever with
    a standard error to match, and read as no effect); then all terms are ``penalised`` (Firth's bias
    reduction), which is finite. ``separated`` marks the terms that split the responses. A term with one value
    in all cells has null numbers. A penalised fit that does not settle is ``unconverged``, with null numbers.
    """
    used = cells.where(F.col(weight) > 0).select(
        F.col(response).cast("double").alias("__y"), F.col(weight).cast("double").alias("__w"),
        *[c.cast("double").alias(f"__t{i}") for i, (_, c) in enumerate(terms)],
    ).dropna()
    names = [n for n, _ in terms]
    seen = _spans(used, len(names))
    if seen["lo"] is None or seen["lo"] == seen["hi"]:
        raise ConstantResponse(f"{response} is constant ({seen['lo']}); the test would pass vacuously")
    varied = [i for i in range(len(names)) if seen[f"low{i}"] != seen[f"high{i}"]]
    separated = {
        names[i] for i in varied
        if seen[f"high{i}_0"] <= seen[f"low{i}_1"] or seen[f"high{i}_1"] <= seen[f"low{i}_0"]
    }
    columns = [f"__t{i}" for i in varied]
    # Terms that split the responses leave no maximum to look for.
    found = None if separated else _likelihood_fit(used, columns, seen["top"])
    kind = "likelihood"
    if found is None:
        found = _penalised_fit(used, columns)
        kind = "penalised" if found else "unconverged"
    estimates = dict(zip([*(names[i] for i in varied), INTERCEPT], found or ()))
    rows = [(n, *estimates.get(n, (None, None))) for n in [*names, INTERCEPT]]
    z = F.try_divide("estimate", "se")
    table = literal_table(cells.sparkSession, rows, _COEFFICIENTS).withColumn("z", z)
    return table.withColumns({
        "p": normal_p_value(F.col("z")), "fit": F.lit(kind), "separated": F.col("term").isin(sorted(separated)),
    })


def _spans(used: DataFrame, terms: int) -> Row:
    """Least and largest value of the response and, over all cells and per response, of every term."""
    spans = [F.min("__y").alias("lo"), F.max("__y").alias("hi"), F.max("__w").alias("top")]
    for i in range(terms):
        t = F.col(f"__t{i}")
        spans += [F.min(t).alias(f"low{i}"), F.max(t).alias(f"high{i}")]
        for y in (0, 1):
            at = F.when(F.col("__y") == y, t)
            spans += [F.min(at).alias(f"low{i}_{y}"), F.max(at).alias(f"high{i}_{y}")]
    return used.agg(*spans).first()


def _likelihood_fit(used: DataFrame, columns: Sequence[str], top: float) -> list[tuple[float, float]] | None:
    """Estimates and standard errors, the intercept last; none where the maximum is not reached."""
    # The solver starts from (w y + 1/2) / (w + 1). Weights above 1 would push that to the
    # boundary and let it diverge; scaling all weights only scales the standard errors.
    scaled = (F.col("__w") / F.lit(float(top))).alias("__s")
    design = VectorAssembler(inputCols=list(columns), outputCol="__features").transform(used.select("__y", scaled, *columns))
    passes = 50
    model = GeneralizedLinearRegression(
        family="binomial", link="logit", featuresCol="__features", labelCol="__y", weightCol="__s",
        tol=1e-10, maxIter=passes,
    ).fit(design)
    if model.summary.numIterations >= passes:
        return None
    errors = [e / top**0.5 for e in model.summary.coefficientStandardErrors]
    return list(zip(map(float, [*model.coefficients, model.intercept]), errors))


def _penalised_fit(used: DataFrame, columns: Sequence[str]) -> list[tuple[float, float]] | None:
    """Firth's fit: the likelihood times the root of the determinant of the information.

    Spark counts the rows and the responses of each pattern of the terms. The passes only need those
    counts, of which more than a dimension's rows are refused.
    """
    counted = used.groupBy(*columns).agg(F.sum("__w").alias("m"), F.sum(F.col("__w") * F.col("__y")).alias("s"))
    table = np.array(take_dimension(counted), dtype=float)
    x = np.column_stack([table[:, :-2], np.ones(len(table))])
    rows, ones = table[:, -2], table[:, -1]

    def state(at):
        linear = x @ at
        q = 1 / (1 + np.exp(-linear))
        v = rows * q * (1 - q)
        information = x.T @ (v[:, None] * x)
        sign, size = np.linalg.slogdet(information)
        fitted = ones @ linear - rows @ np.logaddexp(0, linear) + size / 2
        return (fitted if sign > 0 else -np.inf), q, v, information

    at = np.zeros(x.shape[1])
    now = state(at)
    for _ in range(MAX_PASSES):
        fitted, q, v, information = now
        if not np.isfinite(fitted):
            return None
        inverse = np.linalg.inv(information)
        leverage = v * np.einsum("ij,jk,ik->i", x, inverse, x)
        step = inverse @ (x.T @ (ones - rows * q + leverage * (0.5 - q)))
        largest = np.abs(step).max()
        if largest < STEP:
            return list(zip(at.tolist(), np.sqrt(np.diag(inverse)).tolist()))
        # Far from the maximum a full step may overshoot it: cut, then halved until it does not fall.
        step *= min(1.0, 5.0 / largest)
        for _ in range(30):
            now = state(at + step)
            if now[0] >= fitted - 1e-12 * abs(fitted):
                break
            step = step / 2
        at = at + step
    return None


def treatment_terms(df: DataFrame, column: str) -> list[tuple[str, Column]]:
    """Indicator terms of a categorical predictor; its first label is the baseline.

    The label set is read through a size check: a predictor has few labels.
    """
    labels = sorted(r[0] for r in take_dimension(df.select(column).where(F.col(column).isNotNull()).distinct(), 1_000))
    return [(f"{column}{lv}", (F.col(column) == lv).cast("double")) for lv in labels[1:]]
