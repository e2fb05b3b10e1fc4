"""Extinction-risk and posterior-draw queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataframe.operators import draws as dr
from strataframe.operators.reshape import pivot_lists, pivot_values
from strataframe.plans import reports, risk, stages
from strataframe.workload import inputs as src, query
from strataframe.workload.common import logit_sql, rounded, wald_sql
from strataframe.workload.inputs import INTERVALS, with_


def _signal(spark, sf_dir):
    return stages.range_through(src.dated(spark, sf_dir), src.traits(spark, sf_dir), INTERVALS)


@query("observed_risk", with_(src.SIGNAL_SQL, """
SELECT "group", group_id, count(*) AS n, CAST(sum(ext_signal) AS BIGINT) AS extinctions, round(avg(ext_signal), 6) AS risk
FROM signal GROUP BY 1, 2"""))
def observed_risk(spark, sf_dir):
    return rounded(risk.observed_risk(_signal(spark, sf_dir)))


@query("observed_risk_through_time", with_(src.SIGNAL_SQL, """
SELECT "group", group_id, bin_occ, count(*) AS n, CAST(sum(ext_signal) AS BIGINT) AS extinctions, round(avg(ext_signal), 6) AS risk
FROM signal GROUP BY 1, 2, 3"""))
def observed_risk_through_time(spark, sf_dir):
    return rounded(risk.observed_risk(_signal(spark, sf_dir), ("group", "group_id", "bin_occ")))


@query("observed_risk_contrast", with_(f"""{src.SIGNAL_SQL},
r AS (SELECT "group", avg(ext_signal) FILTER (group_id = 'baseline') AS b, avg(ext_signal) FILTER (group_id = 'megafauna') AS m
  FROM signal GROUP BY 1)""", """
SELECT "group", round(b, 6) AS risk_baseline, round(m, 6) AS risk_megafauna, round(b - m, 6) AS risk_diff FROM r"""))
def observed_risk_contrast(spark, sf_dir):
    return rounded(risk.observed_contrast(_signal(spark, sf_dir)))


@query("prediction_grid", with_(src.SIGNAL_SQL, """
SELECT g."group", s.group_id FROM (SELECT DISTINCT "group" FROM signal) g, (VALUES ('baseline'), ('megafauna')) s(group_id)"""))
def prediction_grid(spark, sf_dir):
    return risk.prediction_grid(_signal(spark, sf_dir))


@query("partition_flag", with_(src.SIGNAL_SQL, "SELECT bin_occ, ext_signal, count(*) AS n FROM signal GROUP BY 1, 2"))
def partition_flag(spark, sf_dir):
    return _signal(spark, sf_dir).groupBy("bin_occ", "ext_signal").agg(F.count(F.lit(1)).alias("n"))


# A saturated model has a closed form: differences of the cells' log odds.
@query("risk_glm", with_(f"""{src.SIGNAL_SQL},
cells AS (SELECT "group" AS g, group_id AS side, sum(ext_signal) AS s, sum(1 - ext_signal) AS f FROM signal GROUP BY 1, 2),
odds AS (SELECT b.g, ln(b.s / b.f) AS b, ln(m.s / m.f) AS m, 1 / b.s + 1 / b.f AS vb, 1 / m.s + 1 / m.f AS vm
  FROM cells b JOIN cells m ON b.g = m.g WHERE b.side = 'baseline' AND m.side = 'megafauna'),
base AS (SELECT b AS b0, m AS m0, vb AS vb0, vm AS vm0 FROM odds ORDER BY g LIMIT 1),
terms AS (
  SELECT '(Intercept)' AS term, b0 AS estimate, sqrt(vb0) AS se FROM base
  UNION ALL SELECT 'megafauna', m0 - b0, sqrt(vm0 + vb0) FROM base
  UNION ALL SELECT 'group' || g, b - b0, sqrt(vb + vb0) FROM odds, base WHERE g <> (SELECT min(g) FROM odds)
  UNION ALL SELECT 'megafauna:group' || g, (m - b) - (m0 - b0), sqrt(vb + vm + vb0 + vm0) FROM odds, base
    WHERE g <> (SELECT min(g) FROM odds))""", """
SELECT term, round(estimate, 5) AS estimate, round(se, 5) AS se, round(estimate / se, 4) AS z FROM terms"""))
def risk_glm(spark, sf_dir):
    fit = risk.risk_model(_signal(spark, sf_dir))
    return fit.select("term", (F.round("estimate", 5) + F.lit(0.0)).alias("estimate"), F.round("se", 5).alias("se"),
                      (F.round("z", 4) + F.lit(0.0)).alias("z"))


# With a slope per side in every group each group is a fit of its own.
@query("risk_glm_through_time", f"""WITH RECURSIVE {src.SIGNAL_SQL},
cells AS (SELECT "group" AS grp, group_id AS d, bin_occ AS x, 1 AS w, sum(ext_signal) AS s, count(*) AS m FROM signal GROUP BY ALL),
{logit_sql("cells")},
base AS (SELECT * FROM fits WHERE grp = (SELECT min(grp) FROM fits)),
single AS (SELECT grp, any_value(a) AS a, any_value(den) AS den FROM fits GROUP BY grp),
terms AS (
  SELECT '(Intercept)' AS term, a AS estimate, 1 / den AS var FROM single WHERE grp = (SELECT min(grp) FROM fits)
  UNION ALL SELECT 'group' || g.grp, g.a - b.a, 1 / g.den + 1 / b.den FROM single g, single b
    WHERE b.grp = (SELECT min(grp) FROM fits) AND g.grp <> b.grp
  UNION ALL SELECT d || ':bin_occ', beta, 1 / i + (j / i) ^ 2 / den FROM base
  UNION ALL SELECT 'group' || f.grp || ':' || f.d || ':bin_occ', f.beta - b.beta, 1 / f.i + (f.j / f.i) ^ 2 / f.den + 1 / b.i + (b.j / b.i) ^ 2 / b.den
    FROM fits f JOIN base b ON f.d = b.d WHERE f.grp <> b.grp),
tested AS (WITH {wald_sql("terms")})
SELECT *, 'likelihood' AS fit, false AS separated FROM tested""")
def risk_glm_through_time(spark, sf_dir):
    return rounded(risk.risk_model_through_time(_signal(spark, sf_dir)))


@query("draw_summary", with_(src.DRAWS_SQL, """
SELECT "group", group_id, bin_occ, round(quantile_cont(linpred, 0.025), 6) AS lower, round(quantile_cont(linpred, 0.5), 6) AS median,
  round(quantile_cont(linpred, 0.975), 6) AS upper FROM draws GROUP BY 1, 2, 3"""))
def draw_summary(spark, sf_dir):
    return rounded(dr.summarise_draws(src.draws(spark, sf_dir), "linpred", ["group", "group_id", "bin_occ"]))


@query("sampling_distribution", with_(src.DRAWS_SQL, "SELECT upper(group_id[1]) || lower(group_id[2:]) AS group_id, " + ", ".join(
    f"round(quantile_cont(exp(linpred), {p}), 6) AS {n}" for n, p in dr.HALF_EYE.items()) + " FROM draws GROUP BY 1"))
def sampling_distribution(spark, sf_dir):
    d = src.draws(spark, sf_dir).select("group_id", F.col("linpred").alias("samp_inx"))
    return rounded(reports.sampling_distribution(dr.back_transform(d, "samp_inx")))


@query("sampling_distribution_limited", with_(src.DRAWS_SQL, "SELECT upper(group_id[1]) || lower(group_id[2:]) AS group_id, " + ", ".join(
    f"round(quantile_cont(exp(linpred), {p}), 6) AS {n}" for n, p in dr.HALF_EYE.items())
    + " FROM draws WHERE exp(linpred) BETWEEN 0.9 AND 1.3 GROUP BY 1"))
def sampling_distribution_limited(spark, sf_dir):
    d = src.draws(spark, sf_dir).select("group_id", F.col("linpred").alias("samp_inx"))
    return rounded(reports.sampling_distribution(dr.back_transform(d, "samp_inx"), limits=(0.9, 1.3)))


CONTRAST_SQL = f"""{src.DRAWS_SQL},
contrast AS (
  SELECT b."group", b.bin_occ, b.draw, b.linpred - m.linpred AS logit
  FROM draws b JOIN draws m ON b."group" = m."group" AND b.bin_occ = m.bin_occ AND b.draw = m.draw
  WHERE b.group_id = 'baseline' AND m.group_id = 'megafauna')"""


@query("draw_contrast", with_(f"{CONTRAST_SQL}, {src.STAGES_SQL}", """
SELECT c.bin_occ, c."group", c.draw AS ".draw", round(c.logit, 6) AS logit,
  round(avg(c.logit) OVER (PARTITION BY c."group", c.bin_occ), 6) AS mean_logit, s.mid AS age
FROM contrast c LEFT JOIN stages s ON c.bin_occ = s.stg"""))
def draw_contrast(spark, sf_dir):
    return rounded(risk.logit_through_time(src.draws(spark, sf_dir), INTERVALS))


@query("contrast_summary", with_(CONTRAST_SQL, """
SELECT "group", bin_occ, round(quantile_cont(logit, 0.025), 6) AS lower, round(quantile_cont(logit, 0.5), 6) AS median,
  round(quantile_cont(logit, 0.975), 6) AS upper FROM contrast GROUP BY 1, 2"""))
def contrast_summary(spark, sf_dir):
    return rounded(risk.logit_summary(src.draws(spark, sf_dir)))


@query("partition_mean", with_(src.DRAWS_SQL, """
SELECT "group", bin_occ, draw, group_id, round(avg(linpred) OVER (PARTITION BY "group", bin_occ), 6) AS mean_value FROM draws"""))
def partition_mean(spark, sf_dir):
    d = dr.with_group_mean(src.draws(spark, sf_dir), "linpred", ["group", "bin_occ"], "mean_value")
    return rounded(d.select("group", "bin_occ", "draw", "group_id", "mean_value"))


@query("bound_contrast", with_(f"""{src.DRAWS_SQL},
s AS (SELECT "group", group_id, quantile_cont(linpred, 0.5) AS median, quantile_cont(linpred, 0.025) AS lower,
  quantile_cont(linpred, 0.975) AS upper FROM draws GROUP BY 1, 2)""", """
SELECT b."group", round(b.median - m.median, 6) AS risk_diff, round(b.lower - m.lower, 6) AS risk_diff_low,
  round(b.upper - m.upper, 6) AS risk_diff_high, round(b.median, 6) AS median_baseline, round(m.median, 6) AS median_megafauna,
  round(b.lower, 6) AS lower_baseline, round(m.lower, 6) AS lower_megafauna,
  round(b.upper, 6) AS upper_baseline, round(m.upper, 6) AS upper_megafauna
FROM s b JOIN s m ON b."group" = m."group" WHERE b.group_id = 'baseline' AND m.group_id = 'megafauna'"""))
def bound_contrast(spark, sf_dir):
    d = src.draws(spark, sf_dir).withColumnRenamed("linpred", "epred")
    return rounded(risk.risk_from_draws(d))


HALVES_SQL = """halves AS (
  SELECT vec_id, label, list_transform(embedding[1:32], lambda x: CAST(x AS DOUBLE)) AS a,
         list_transform(embedding[33:64], lambda x: CAST(x AS DOUBLE)) AS b FROM embeddings)"""


def _halves(spark, sf_dir):
    """Each vector as two list cells of 32 draws: the two sides of one grid cell."""
    return src.table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.posexplode("embedding").alias("pos", "v")
    ).select("vec_id", "label", F.when(F.col("pos") < 32, "baseline").otherwise("megafauna").alias("side"),
             (F.col("pos") % 32).alias("draw"), F.col("v").cast("double").alias("v"))


@query("pivot_lists", with_(HALVES_SQL, """
SELECT vec_id, CAST(p - 1 AS INTEGER) AS pos, round(a[p], 6) AS baseline, round(b[p], 6) AS megafauna,
  CAST(len(b) AS INTEGER) AS megafauna_draws FROM halves, (SELECT unnest(generate_series(1, 32)) AS p)"""))
def pivot_lists_query(spark, sf_dir):
    wide = pivot_lists(_halves(spark, sf_dir), ["vec_id"], "side", ["baseline", "megafauna"], "v", "draw")
    cells = wide.select("vec_id", F.size("megafauna").alias("megafauna_draws"),
                        F.posexplode(F.arrays_zip("baseline", "megafauna")).alias("pos", "cell"))
    return rounded(cells.select("vec_id", "pos", "cell.baseline", "cell.megafauna", "megafauna_draws"))


@query("draw_array_diff", with_(HALVES_SQL, """
SELECT vec_id, CAST(p - 1 AS INTEGER) AS pos, round(logit[p], 6) AS logit FROM (
  SELECT vec_id, list_transform(list_zip(a, b), lambda x: x[1] - x[2]) AS logit FROM halves), (SELECT unnest(generate_series(1, 32)) AS p)"""))
def draw_array_diff(spark, sf_dir):
    as_doubles = F.transform("embedding", lambda x: x.cast("double"))
    e = src.table(spark, sf_dir, "embeddings").select("vec_id", as_doubles.alias("e"))
    diff = dr.contrast_lists(F.slice("e", 1, 32), F.slice("e", 33, 32))
    return rounded(e.select("vec_id", F.posexplode(diff).alias("pos", "logit")))


@query("element_access", "SELECT vec_id, CAST(embedding[2] AS DOUBLE) AS second, CAST(embedding[100] AS DOUBLE) AS beyond FROM embeddings")
def element_access(spark, sf_dir):
    e = src.table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.get("embedding", 1).cast("double").alias("second"),
                    F.get("embedding", 99).cast("double").alias("beyond"))


@query("row_number_keyed", with_(src.DRAWS_SQL, """
SELECT "group", bin_occ, group_id, draw, CAST(row_number() OVER (PARTITION BY "group", bin_occ, group_id ORDER BY draw) AS BIGINT) AS "number"
FROM draws"""))
def row_number_keyed(spark, sf_dir):
    from strataframe.operators.ranking import keyed_row_number

    d = src.draws(spark, sf_dir).select("group", "bin_occ", "group_id", "draw")
    return keyed_row_number(d, ["group", "bin_occ", "group_id"], ["draw"], "number")


@query("pivot_several_values", """
SELECT o_orderpriority, """ + ", ".join(
    f"count(*) FILTER (o_orderstatus = '{s}') AS n_{s}, max(o_totalprice) FILTER (o_orderstatus = '{s}') AS top_{s}" for s in "FOP")
    + " FROM orders GROUP BY 1")
def pivot_several_values(spark, sf_dir):
    return pivot_values(src.table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus", list("FOP"),
                        {"n": F.count(F.lit(1)), "top": F.max("o_totalprice")})
