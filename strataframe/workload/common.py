"""Rounding shared by the queries: both engines round doubles before comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[
        (F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`")
        for c, t in df.dtypes
    ])


def tails_sql(fits: str, tail: float = 0.05) -> str:
    """CTEs ``tails`` (k, p, critical) for ``fits`` (k, t, dof) by Simpson's rule, not by the functions under test.

    With v = sqrt(dof) atan(t / sqrt(dof)) the Student-t density is cos(v / sqrt(dof))^(dof - 1) but for a factor.
    """
    f = lambda v: f"greatest(cos(({v}) / sqrt(dof)), 0) ^ (dof - 1)"
    return f"""nodes AS (SELECT k, dof, i, least(40, pi() / 2 * sqrt(dof)) / 16000 AS h
  FROM (SELECT k, CAST(dof AS DOUBLE) AS dof FROM {fits} WHERE dof > 0), (SELECT unnest(range(16001)) AS i)),
heights AS (SELECT *, {f("i * h")} AS y FROM nodes),
parts AS (SELECT *, CASE WHEN i > 0 THEN h * (lag(y, 2) OVER w + 4 * lag(y) OVER w + y) / 3 ELSE 0 END AS s
  FROM heights WINDOW w AS (PARTITION BY k ORDER BY i)),
areas AS (SELECT k, dof, i, h, y, sum(s) OVER (PARTITION BY k ORDER BY i) AS area FROM parts WHERE i % 2 = 0),
whole AS (SELECT k, max(area) AS all_area FROM areas GROUP BY k),
placed AS (SELECT f.k, f.t, CAST(f.dof AS DOUBLE) AS dof, sqrt(f.dof) * atan(abs(f.t) / sqrt(f.dof)) AS v FROM {fits} f WHERE f.dof > 0),
ps AS (SELECT p.k, CASE WHEN p.t IS NULL THEN NULL WHEN a.k IS NULL THEN 0 ELSE greatest(0, 1 - (a.area + (v - i * h) / 6 * (y
  + 4 * greatest(cos((v + i * h) / 2 / sqrt(p.dof)), 0) ^ (p.dof - 1) + greatest(cos(v / sqrt(p.dof)), 0) ^ (p.dof - 1))) / all_area) END AS p
  FROM placed p JOIN whole USING (k) LEFT JOIN areas a ON a.k = p.k AND a.i = 2 * floor(v / (2 * h)) AND a.i < 16000),
edge AS (SELECT k, dof, i * h AS v0, y, {1 - tail} * all_area - area AS rest,
  -(dof - 1) / sqrt(dof) * tan(i * h / sqrt(dof)) * y AS slope FROM areas JOIN whole USING (k)
  WHERE area <= {1 - tail} * all_area QUALIFY row_number() OVER (PARTITION BY k ORDER BY i DESC) = 1),
criticals AS (SELECT k, sqrt(dof) * tan((v0 + 2 * rest / (y + sqrt(y * y + 2 * slope * rest))) / sqrt(dof)) AS critical FROM edge),
tails AS (SELECT k, p, critical FROM ps JOIN criticals USING (k))"""


def logit_sql(cells: str, passes: int = 40) -> str:
    """CTEs ``fits`` (grp, d, beta, a, i, j, den) of logit = beta_d x + a w for ``cells`` (grp, d, x, w, s, m), one fit per grp.

    No cell has two values of d, so the information is diagonal but for the border of w and every Newton step
    is closed. The variance of beta_d is 1 / i + (j / i)^2 / den, that of a is 1 / den.
    """
    q = "1 / (1 + exp(-(f.beta * c.x + f.a * c.w)))"
    return f"""steps AS (
  SELECT 0 AS pass, grp, d, 0.0::DOUBLE AS beta, 0.0::DOUBLE AS a, 0.0::DOUBLE AS i, 0.0::DOUBLE AS j, 0.0::DOUBLE AS den FROM {cells} GROUP BY grp, d
  UNION ALL
  SELECT pass + 1, grp, d, beta + (u - j * da) / i, a + da, i, j, den FROM (
    SELECT *, sum(t - j * u / i) OVER g / den AS da FROM (
      SELECT *, sum(k - j * j / i) OVER g AS den FROM (
        SELECT pass, grp, d, beta, a, sum(v * x * x) AS i, sum(v * x * w) AS j, sum(v * w * w) AS k, sum(r * x) AS u, sum(r * w) AS t FROM (
          SELECT f.pass, f.grp, f.d, f.beta, f.a, c.x, c.w, c.m * {q} * (1 - {q}) AS v, c.s - c.m * {q} AS r
          FROM steps f JOIN {cells} c ON c.grp = f.grp AND c.d = f.d WHERE f.pass < {passes})
        GROUP BY pass, grp, d, beta, a) WINDOW g AS (PARTITION BY grp)) WINDOW g AS (PARTITION BY grp))),
fits AS (SELECT * FROM steps WHERE pass = {passes})"""


def wald_sql(terms: str) -> str:
    """Rounded Wald table of ``terms`` (term, estimate, var). The normal tail is an integral by Simpson's rule."""
    density = "exp(-0.5 * (o * h) ^ 2)"
    return f"""wald AS (SELECT term, estimate, sqrt(var) AS se, estimate / sqrt(var) AS z, least(abs(estimate / sqrt(var)), 12) / 4000 AS h FROM {terms})
SELECT term, round(estimate, 6) AS estimate, round(any_value(se), 6) AS se, round(any_value(z), 6) AS z,
  round(greatest(0, 1 - 2 / sqrt(2 * pi()) * sum(h / 3 * {density} * CASE WHEN o IN (0, 4000) THEN 1 WHEN o % 2 = 1 THEN 4 ELSE 2 END)), 6) AS p
FROM wald, (SELECT unnest(range(4001)) AS o) GROUP BY term, estimate"""


def number_sql(value: str) -> str:
    """One decimal place, without a trailing zero; null reads NA."""
    return f"coalesce(regexp_replace(CAST(CAST(round({value}, 1) AS DECIMAL(20, 1)) AS VARCHAR), '\\.0$', ''), 'NA')"
