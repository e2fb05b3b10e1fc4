"""Regression, density, histogram and significance queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from strataframe.functions.text import percent_text
from strataframe.operators import aggregates as agg
from strataframe.operators import density, regression
from strataframe.operators.quantiles import exact_quantiles
from strataframe.operators.reshape import unpivot
from strataframe.plans import reports
from strataframe.sources.dimensions import small_table
from strataframe.workload import inputs as src, query
from strataframe.workload.appearances import FROM_OCCURRENCES_SQL, _differences
from strataframe.workload.common import logit_sql, number_sql, rounded, tails_sql, wald_sql
from strataframe.workload.inputs import with_


def _priced(spark, sf_dir):
    return src.table(spark, sf_dir, "lineitem").select(
        "l_returnflag", F.log("l_extendedprice").alias("y"), F.col("l_quantity").alias("x"))


def _ols_sql(select: str, group: str) -> str:
    return f"""WITH m AS (SELECT {select} regr_count(y, x) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept,
  regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy
  FROM (SELECT l_returnflag, ln(l_extendedprice) AS y, l_quantity AS x FROM lineitem) {group}),
s AS (SELECT *, sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) AS se FROM m)
SELECT {select} CAST(n AS BIGINT) AS n, round(slope, 8) AS slope, round(intercept, 8) AS intercept, CAST(n - 2 AS BIGINT) AS dof,
  round(se, 8) AS se, round(slope / se, 4) AS t FROM s"""


def _ols_rounded(fits):
    r = {c: F.round(c, d) for c, d in (("slope", 8), ("intercept", 8), ("se", 8), ("t", 4))}
    return fits.withColumns(r)


@query("ols_by_group", _ols_sql("l_returnflag,", "GROUP BY 1"))
def ols_by_group(spark, sf_dir):
    return _ols_rounded(regression.least_squares(_priced(spark, sf_dir), "y", "x", ["l_returnflag"]))


@query("ols_overall", _ols_sql("", ""))
def ols_overall(spark, sf_dir):
    return _ols_rounded(regression.least_squares(_priced(spark, sf_dir), "y", "x"))


@query("fit_endpoints", """
WITH m AS (SELECT l_returnflag, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, min(x) AS lo, max(x) AS hi
  FROM (SELECT l_returnflag, ln(l_extendedprice) AS y, l_quantity AS x FROM lineitem) GROUP BY 1)
SELECT l_returnflag, lo AS x, round(a + b * lo, 6) AS fitted FROM m UNION ALL SELECT l_returnflag, hi, round(a + b * hi, 6) FROM m""")
def fit_endpoints(spark, sf_dir):
    return rounded(regression.fitted_ends(_priced(spark, sf_dir), "y", "x", ["l_returnflag"]))


_INFERENCE_SQL = f"""WITH m AS (SELECT l_returnflag AS k, regr_count(y, x) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept,
  regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy
  FROM (SELECT l_returnflag, ln(l_extendedprice) AS y, l_quantity AS x FROM lineitem) GROUP BY 1),
fits AS (SELECT k, n, slope, intercept, n - 2 AS dof, sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) AS se, slope / se AS t FROM m),
{tails_sql("fits")}
SELECT k AS l_returnflag, CAST(n AS BIGINT) AS n, round(slope, 8) AS slope, round(intercept, 8) AS intercept, CAST(dof AS BIGINT) AS dof,
  round(se, 8) AS se, round(t, 4) AS t, round(p, 8) AS p_value, round(slope - critical * se, 8) AS lower, round(slope + critical * se, 8) AS upper
FROM fits JOIN tails USING (k)"""


@query("ols_inference", _INFERENCE_SQL)
def ols_inference(spark, sf_dir):
    fits = regression.with_inference(regression.least_squares(_priced(spark, sf_dir), "y", "x", ["l_returnflag"]))
    return _ols_rounded(fits).withColumns({c: F.round(c, 8) for c in ("p_value", "lower", "upper")})


def _trend_sql(as_published: bool) -> str:
    per = lambda v: number_sql(f"(exp({v}) - 1) * 100 * 10") + " || '%'"
    one_star = "p BETWEEN 0.05 AND 0.01" if as_published else "p BETWEEN 0.01 AND 0.05"
    star = f"CASE WHEN p > 0.05 THEN 'ns' WHEN p BETWEEN 0.001 AND 0.01 THEN '**' WHEN {one_star} THEN '*' WHEN p < 0.001 THEN '***' END"
    if as_published:
        star = f"CASE WHEN k = 'Overall' THEN '***' ELSE {star} END"
    return with_(f"""{src.TRAITS_SQL},
points AS (SELECT "group", ln(max_size_m) AS y, -((age_early_epoch - age_late_epoch) / 2 + age_late_epoch) AS x FROM traits),
both_ AS (SELECT "group" AS k, y, x FROM points UNION ALL SELECT 'Overall', y, x FROM points),
m AS (SELECT k, regr_count(y, x) AS n, regr_slope(y, x) AS slope, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM both_ GROUP BY 1),
fits AS (SELECT k, slope, n - 2 AS dof, sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) AS se, slope / se AS t FROM m),
{tails_sql("fits")}""", f"""
SELECT k AS "group", {per("slope")} AS mean_trend, {star} AS p_star,
  '[' || {per("slope - critical * se")} || ', ' || {per("slope + critical * se")} || ']' AS "CI" FROM fits LEFT JOIN tails USING (k)""")


@query("trend_table", _trend_sql(False))
def trend_table(spark, sf_dir):
    return reports.size_trend(src.traits(spark, sf_dir))


@query("trend_table_published", _trend_sql(True))
def trend_table_published(spark, sf_dir):
    return reports.size_trend(src.traits(spark, sf_dir), as_published=True)


@query("percent_text", with_(f"""{src.TRAITS_SQL},
fit AS (SELECT "group", (exp(regr_slope(ln(max_size_m), -((age_early_epoch - age_late_epoch) / 2 + age_late_epoch))) - 1) * 100 * 1000 AS v
  FROM traits GROUP BY 1)""", r"""
SELECT "group", regexp_replace(CAST(CAST(round(v, 1) AS DECIMAL(20, 1)) AS VARCHAR), '\.0$', '') || '%' AS mean_trend FROM fit"""))
def percent_text_query(spark, sf_dir):
    t = src.traits(spark, sf_dir)
    points = t.select("group", F.log("max_size_m").alias("y"),
                      (-((F.col("age_early_epoch") - F.col("age_late_epoch")) / 2 + F.col("age_late_epoch"))).alias("x"))
    fits = regression.least_squares(points, "y", "x", ["group"])
    return fits.select("group", percent_text((F.exp("slope") - 1) * 100 * 1000).alias("mean_trend"))


_P = "l_discount / l_quantity"


def _stars(spark, sf_dir, as_published):
    p = F.col("l_discount") / F.col("l_quantity")
    star = regression.stars(p, as_published=as_published)
    return src.table(spark, sf_dir, "lineitem").groupBy(star.alias("p_star")).agg(F.count(F.lit(1)).alias("n"))


@query("stars_published", f"""
SELECT CASE WHEN {_P} > 0.05 THEN 'ns' WHEN {_P} BETWEEN 0.05 AND 0.01 THEN '*' WHEN {_P} BETWEEN 0.001 AND 0.01 THEN '**'
  WHEN {_P} < 0.001 THEN '***' END AS p_star, count(*) AS n FROM lineitem GROUP BY 1""")
def stars_published(spark, sf_dir):
    return _stars(spark, sf_dir, True)


@query("stars_fixed", f"""
SELECT CASE WHEN {_P} > 0.05 THEN 'ns' WHEN {_P} BETWEEN 0.001 AND 0.01 THEN '**' WHEN {_P} BETWEEN 0.01 AND 0.05 THEN '*'
  WHEN {_P} < 0.001 THEN '***' END AS p_star, count(*) AS n FROM lineitem GROUP BY 1""")
def stars_fixed(spark, sf_dir):
    return _stars(spark, sf_dir, False)


@query("all_above_alpha", "SELECT l_suppkey, bool_and(l_discount / l_quantity > 0.00005 OR l_linestatus = 'O') AS is_mar FROM lineitem GROUP BY 1")
def all_above_alpha(spark, sf_dir):
    above = (F.col("l_discount") / F.col("l_quantity") > 0.00005) | (F.col("l_linestatus") == "O")
    return src.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(agg.all_true(above).alias("is_mar"))


def _mar_ctes() -> str:
    missing = " OR ".join(f"{c} IS NULL" for c in reports.TRAITS)
    return f"""RECURSIVE {src.TRAITS_SQL},
flagged AS (SELECT early_era, taxonomic_rank, CAST({missing} AS INTEGER) AS y FROM traits WHERE early_era IS NOT NULL AND taxonomic_rank IS NOT NULL),
ends AS (SELECT min(taxonomic_rank) AS rank0, max(taxonomic_rank) AS rank1, min(early_era) AS era0 FROM flagged),
cells AS (SELECT 0 AS grp, early_era AS d, 1 AS x, CAST(taxonomic_rank <> rank0 AS INTEGER) AS w, sum(y) AS s, count(*) AS m FROM flagged, ends GROUP BY ALL),
{logit_sql("cells")},
base AS (SELECT f.* FROM fits f, ends WHERE d = era0),
terms AS (
  SELECT '(Intercept)' AS term, beta AS estimate, 1 / i + (j / i) ^ 2 / den AS var FROM base
  UNION ALL SELECT 'taxonomic_rank' || rank1, a, 1 / den FROM base, ends
  UNION ALL SELECT 'early_era' || f.d, f.beta - b.beta, 1 / f.i + 1 / b.i + (f.j / f.i - b.j / b.i) ^ 2 / f.den FROM fits f, base b WHERE f.d <> b.d)"""


def _missing_tests(spark, sf_dir):
    return reports.missing_at_random(src.traits(spark, sf_dir), ["early_era", "taxonomic_rank"])


@query("mar_logit", f"WITH {_mar_ctes()}, tested AS (WITH {wald_sql('terms')}) SELECT *, 'likelihood' AS fit, false AS separated FROM tested")
def mar_logit(spark, sf_dir):
    return rounded(_missing_tests(spark, sf_dir))


@query("mar_flag", f"WITH {_mar_ctes()}, tested AS (WITH {wald_sql('terms')}) SELECT bool_and(p > 0.05) AS is_mar FROM tested")
def mar_flag(spark, sf_dir):
    return reports.all_above(_missing_tests(spark, sf_dir))


# Years wholly before or after the day split the responses. A penalised fit of one factor adds half a row to both answers of each year.
@query("separated_logit", f"""WITH years AS (SELECT CAST(year(o_orderdate) AS VARCHAR) AS y, count(*) AS m,
  sum(CAST(o_orderdate >= TIMESTAMP '1998-07-01' AS INTEGER)) AS s FROM orders GROUP BY 1),
odds AS (SELECT y, s, m, ln((s + 0.5) / (m - s + 0.5)) AS b, (m + 1.0) * (m + 1.0) / (m * (s + 0.5) * (m - s + 0.5)) AS v FROM years),
base AS (SELECT * FROM odds ORDER BY y LIMIT 1),
terms AS (SELECT '(Intercept)' AS term, b AS estimate, v AS var FROM base
  UNION ALL SELECT 'year' || o.y, o.b - z.b, o.v + z.v FROM odds o, base z WHERE o.y <> z.y),
tested AS (WITH {wald_sql("terms")})
SELECT t.*, 'penalised' AS fit, coalesce(o.s IN (0, o.m), false) AS separated FROM tested t LEFT JOIN odds o ON t.term = 'year' || o.y""")
def separated_logit(spark, sf_dir):
    """Orders from the middle of 1998 on, by year."""
    late = (F.col("o_orderdate") >= F.lit("1998-07-01").cast("timestamp")).cast("int")
    dated = src.table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("string").alias("year"), late.alias("late"))
    cells = small_table(agg.counts(dated, ["year", "late"]))
    return rounded(regression.logistic_fit(cells, "late", "n", regression.treatment_terms(cells, "year")))


@query("quantiles_by_type", """
SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.025), 6) AS q_0, round(quantile_cont(value, 0.17), 6) AS q_1,
  round(quantile_cont(value, 0.5), 6) AS q_2, round(quantile_cont(value, 0.83), 6) AS q_3, round(quantile_cont(value, 0.975), 6) AS q_4
FROM events GROUP BY 1""")
def quantiles_by_type(spark, sf_dir):
    e = src.table(spark, sf_dir, "events")
    return rounded(exact_quantiles(e, "value", [0.025, 0.17, 0.5, 0.83, 0.975], by=["event_type"], n_name="n"))


@query("quantiles_overall", "SELECT round(quantile_cont(l_extendedprice, 0.25), 6) AS q1, round(quantile_cont(l_extendedprice, 0.75), 6) AS q3 FROM lineitem")
def quantiles_overall(spark, sf_dir):
    return rounded(exact_quantiles(src.table(spark, sf_dir, "lineitem"), "l_extendedprice", [0.25, 0.75], names=["q1", "q3"]))


@query("hist_raw", "SELECT CAST(ceil(value / 10 - 0.5) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1")
def hist_raw(spark, sf_dir):
    return density.histogram(src.table(spark, sf_dir, "events"), "value", 10.0)


@query("hist_log", "SELECT CAST(ceil(ln(1 + value) / 0.25::DOUBLE - 0.5) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1")
def hist_log(spark, sf_dir):
    e = src.table(spark, sf_dir, "events").select(F.log1p("value").alias("x"))
    return density.histogram(e, "x", 0.25)


def kde_sql(ctes: str, key: str, grid: int, points: int, lower_bound: float | None = None) -> str:
    """Oracle of ``kernel_density`` over a CTE ``rows(<key>, x)``."""
    start = "min(x)" if lower_bound is None else f"{lower_bound}::DOUBLE"

    def term(at: str) -> str:
        t = f"(({at} - lo) / step)"
        phi = lambda p: f"exp(-0.5 * (({p} - cell) * step / bw) * (({p} - cell) * step / bw))"
        return f"(1 - ({t} - floor({t}))) * {phi(f'floor({t})')} + ({t} - floor({t})) * {phi(f'(floor({t}) + 1)')}"

    mass = f"({term('x')})"
    if lower_bound is not None:
        mass = f"({term('x')} + {term(f'(2 * {lower_bound} - x)')})"
    return f"""WITH {ctes},
q AS (SELECT {key}, count(*) AS n, stddev_samp(x) AS sd, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3, min(x) AS mn
  FROM rows GROUP BY 1),
bw AS (SELECT {key}, n, 0.9 * coalesce(nullif(least(sd, (q3 - q1) / 1.34), 0), nullif(sd, 0), nullif(abs(mn), 0), 1)
  * pow(n::DOUBLE, -0.2) AS bw FROM q WHERE n > 1),
axis AS (SELECT bw.*, f, t, f - 4 * bw AS lo, (t + 4 * bw - (f - 4 * bw)) / {grid - 1} AS step
  FROM bw, (SELECT {start} AS f, max(x) AS t FROM rows) r),
placed AS (SELECT a.*, floor((x - lo) / step) AS c, (x - lo) / step - floor((x - lo) / step) AS frac FROM rows JOIN axis a USING ({key})),
binned AS (SELECT {key}, n, bw, f, t, lo, step, cell, sum(w) AS w FROM (
  SELECT * EXCLUDE (c, frac), c AS cell, 1 - frac AS w FROM placed UNION ALL SELECT * EXCLUDE (c, frac), c + 1, frac FROM placed) GROUP BY ALL),
grid AS (SELECT b.*, CAST(p AS INTEGER) AS point, f + p * (t - f) / {points - 1} AS x
  FROM binned b, (SELECT unnest(generate_series(0, {points - 1})) AS p) g)
SELECT {key}, point, round(x, 6) AS x, round(sum(w * {mass} / (n * bw * {math.sqrt(2 * math.pi)!r}::DOUBLE)), 8) AS density
FROM grid GROUP BY {key}, point, grid.x"""


def _density_rounded(df):
    return df.withColumn("x", F.round("x", 6)).withColumn("density", F.round("density", 8))


@query("kde_by_type", kde_sql("rows AS (SELECT event_type, value AS x FROM events)", "event_type", 512, 128))
def kde_by_type(spark, sf_dir):
    e = src.table(spark, sf_dir, "events")
    return _density_rounded(density.kernel_density(e, "value", ["event_type"], out_points=128))


@query("kde_log_size_bounded", kde_sql(f'{src.TRAITS_SQL}, rows AS (SELECT "group" AS g, ln(max_size_m) AS x FROM traits)', "g", 256, 64, 0.0))
def kde_log_size_bounded(spark, sf_dir):
    t = src.traits(spark, sf_dir).select(F.col("group").alias("g"), F.log("max_size_m").alias("x"))
    return _density_rounded(density.kernel_density(t, "x", ["g"], grid=256, out_points=64, lower_bound=0.0))


def _spatial_sql(axis: str) -> str:
    rows = f"""rows AS (SELECT era_min AS era, {axis} AS x FROM (
  SELECT *, {src.cut_sql('max_ma', src.ERA_BREAKS, src.ERA_LABELS)} AS era_max,
         {src.cut_sql('min_ma', src.ERA_BREAKS, src.ERA_LABELS)} AS era_min FROM occurrences) o
  JOIN (SELECT DISTINCT "group", genus FROM traits) g ON o.genus = g.genus WHERE era_max = era_min)"""
    return kde_sql(f"{src.OCCURRENCES_SQL}, {src.TRAITS_SQL}, {rows}", "era", 256, 64)


def _spatial_density(spark, sf_dir, axis):
    located = reports.spatial_by_era(src.occurrences(spark, sf_dir), src.traits(spark, sf_dir),
                                     breaks=src.ERA_BREAKS, labels=src.ERA_LABELS)
    return _density_rounded(reports.coordinate_density(located, axis, grid=256, out_points=64))


@query("kde_latitude_by_era", _spatial_sql("lat"))
def kde_latitude_by_era(spark, sf_dir):
    return _spatial_density(spark, sf_dir, "lat")


@query("kde_longitude_by_era", _spatial_sql("lng"))
def kde_longitude_by_era(spark, sf_dir):
    return _spatial_density(spark, sf_dir, "lng")


@query("kde_sampling", kde_sql(f"{src.DRAWS_SQL}, rows AS (SELECT group_id, exp(linpred) AS x FROM draws)", "group_id", 256, 64))
def kde_sampling(spark, sf_dir):
    d = src.draws(spark, sf_dir).select("group_id", F.exp("linpred").alias("x"))
    return _density_rounded(density.kernel_density(d, "x", ["group_id"], grid=256, out_points=64))


@query("kde_age_differences", kde_sql(f"""{FROM_OCCURRENCES_SQL}, rows AS (SELECT 'LAD' AS name, "LAD" AS x FROM age_diff
  WHERE "LAD" IS NOT NULL UNION ALL SELECT 'FAD', "FAD" FROM age_diff WHERE "FAD" IS NOT NULL)""", "name", 256, 64))
def kde_age_differences(spark, sf_dir):
    long = unpivot(_differences(spark, sf_dir), ["taxon"], ["LAD", "FAD"], "name", "value")
    return _density_rounded(density.kernel_density(long, "value", ["name"], grid=256, out_points=64))
