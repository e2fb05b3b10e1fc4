"""Arithmetic used by the reports, and the tail probabilities Spark lacks, as expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: Steps that any tail probability takes at least; the incomplete beta function needs more with its parameters.
TERMS = 60
#: Degrees of freedom beyond which a normal tail stands for the Student-t tail.
MANY = 10_000


def age_midpoint(older: Column, younger: Column) -> Column:
    return (older - younger) / 2 + younger


def forward_time(older: Column, younger: Column) -> Column:
    """Negated midpoint, so that slopes read per million years forward in time."""
    return -age_midpoint(older, younger)


def percent_change(log_slope: Column) -> Column:
    return (F.exp(log_slope) - 1) * 100


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _steps(n: Column) -> Column:
    return F.sequence(F.lit(1), n.cast("int"))


def _log_beta_half(a: Column) -> Column:
    """log B(a, 1/2): the ratio of the gammas is moved up by 16 and expanded there."""
    top = a + 16
    lower = F.aggregate(F.sequence(F.lit(0), F.lit(15)), F.lit(0.0), lambda s, i: s + F.log1p(0.5 / (a + i)))
    ratio = -0.5 * F.log(top) + 1 / (8 * top) - 1 / (192 * F.pow(top, 3)) + 1 / (640 * F.pow(top, 5)) - 17 / (14336 * F.pow(top, 7))
    return 0.5723649429247001 + lower + ratio


def _beta_fraction(a: Column, b: Column, x: Column, terms: Column) -> Column:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    fix = lambda v: F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)

    def step(acc: Column, term: Column) -> Column:
        d, c = 1 / fix(1 + term * acc["d"]), fix(1 + term / acc["c"])
        return _once(F.struct(d.alias("d"), c.alias("c")), lambda t: F.struct(t["c"].alias("c"), t["d"].alias("d"), (acc["out"] * t["d"] * t["c"]).alias("out")))

    def both(acc: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return _once(step(acc, even), lambda t: step(t, odd))

    first = 1 / fix(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("out"))
    return F.aggregate(_steps(terms), start, both, lambda acc: acc["out"])


def _beta_half(a: Column, x: Column, y: Column) -> Column:
    """Regularised incomplete beta function I_x(a, 1/2) for y = 1 - x, both above 0."""
    # The fraction converges within some square roots of the larger parameter.
    terms = F.lit(TERMS) + 6 * F.sqrt(a)
    front = F.exp(a * F.when(y < 0.5, F.log1p(-y)).otherwise(F.log(x)) + 0.5 * F.log(y) - _log_beta_half(a))
    return F.when(x >= (a + 1) / (a + 2.5), 1 - 2 * front * _beta_fraction(F.lit(0.5), a, y, terms)).otherwise(
        front * _beta_fraction(a, F.lit(0.5), x, terms) / a)


def _t_tail(ratio: Column, dof: Column) -> Column:
    """Two-sided Student-t tail of ``ratio`` = t^2 / dof.

    With many degrees of freedom through Hill's normalising expansion, which is exact there to about eleven digits,
    so that the work has a bound whatever the number of rows behind a fit.
    """
    a = dof - 0.5
    b = 48 * a * a
    y = a * F.log1p(ratio)
    normal = lambda y: _normal_tail(F.sqrt(y / 2) * (
        ((((-0.4 * y - 3.3) * y - 24) * y - 85.5) / (0.8 * y * y + 100 + b) + y + 3) / b + 1))
    share = ratio / (1 + ratio)
    return F.when(ratio == 0, F.lit(1.0)).when(F.isnan(share), F.lit(0.0)).when(dof > MANY, _once(y, normal)).otherwise(
        _beta_half(dof / 2, 1 / (1 + ratio), share))


def t_p_value(t: Column, dof: Column) -> Column:
    """Two-sided Student-t tail probability; null without degrees of freedom or for a null or NaN ``t``."""
    t, dof = t.cast("double"), dof.cast("double")
    tail = _once(F.struct(dof.alias("n"), (t * t / dof).alias("r")), lambda v: _t_tail(v["r"], v["n"]))
    return F.when((dof > 0) & t.isNotNull() & ~F.isnan(t), F.greatest(F.lit(0.0), F.least(F.lit(1.0), tail)))


def t_critical(tail: float, dof: Column) -> Column:
    """Positive t whose two-sided tail probability is ``tail``, by bisection on t^2 / dof."""
    def halve(acc: Column, _: Column) -> Column:
        at = (acc["lo"] + acc["hi"]) / 2
        return _once(F.struct(at.alias("at"), (_once(F.exp(at), lambda r: _t_tail(r, acc["n"])) > tail).alias("over")), lambda v: F.struct(
            acc["n"].alias("n"), F.when(v["over"], v["at"]).otherwise(acc["lo"]).alias("lo"), F.when(v["over"], acc["hi"]).otherwise(v["at"]).alias("hi")))

    # On a logarithmic scale, since the ratio is small where there are many degrees of freedom.
    dof = dof.cast("double")
    start = F.struct(dof.alias("n"), F.lit(-70.0).alias("lo"), F.lit(70.0).alias("hi"))
    found = F.aggregate(_steps(F.lit(TERMS)), start, halve, lambda acc: (acc["lo"] + acc["hi"]) / 2)
    return F.when(dof > 0, F.sqrt(dof * F.exp(found)))


def _normal_tail(x: Column) -> Column:
    """Complement of the error function for x >= 0: the series of the function, or the fraction of its complement from 3 on."""
    def tail(x: Column) -> Column:
        series = F.aggregate(_steps(F.lit(TERMS)), F.struct(x.alias("term"), x.alias("sum")), lambda acc, n: _once(
            acc["term"] * 2 * x * x / (2 * n + 1), lambda t: F.struct(t.alias("term"), (acc["sum"] + t).alias("sum"))), lambda acc: acc["sum"])
        fraction = F.aggregate(F.sequence(F.lit(TERMS), F.lit(1), F.lit(-1)), F.lit(0.0), lambda f, n: n / 2 / (x + f))
        decay = F.exp(-x * x) / 1.772453850905516
        return F.when(x < 3, F.greatest(F.lit(0.0), 1 - 2 * decay * series)).otherwise(decay / (x + fraction))

    return _once(x, tail)


def normal_p_value(z: Column) -> Column:
    """Two-sided normal tail, 2 * (1 - Phi(|z|)); null for a null or NaN ``z``."""
    z = z.cast("double")
    return F.when(z.isNotNull() & ~F.isnan(z), _normal_tail(F.abs(z) / 1.4142135623730951))
