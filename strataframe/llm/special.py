"""Distribution functions as SQL expressions, evaluated where the rows are."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 8, exact to about 1e-13."""
    x = n.cast("double") + 9
    series = 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5)))
    tail = F.lit(0.0)
    for i in range(1, 9):
        tail = tail + F.log(n.cast("double") + i)
    return (x - 0.5) * F.log(x) - x + 0.9189385332046727 + series - tail


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial (n, p), k below n: terms from k downwards until they no longer count."""
    k, n = k.cast("long"), n.cast("long")
    first = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    steps = F.least(k, (40 * F.sqrt(n.cast("double")) + 40).cast("long"))

    def add(acc: Column, i: Column) -> Column:
        # i terms are in; the next is smaller by (k - i + 1) (1 - p) / ((n - k + i) p).
        term = acc["term"] * (k - i + 1) * (1 - p) / ((n - k + i) * p)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    ratio = F.aggregate(F.when(steps >= 1, F.sequence(F.lit(1).cast("long"), steps)).otherwise(F.array().cast("array<long>")),
                        start, add, lambda acc: acc["sum"])
    return F.least(F.lit(1.0), F.exp(first + F.log(ratio)))


def hypergeometric(total: Column, good: Column, drawn: Column, uniform: Column) -> Column:
    """Good items among ``drawn`` of ``total`` with ``good`` good ones, by inversion of one uniform number.

    Values more than ten standard deviations from the mean are left out; they have no measurable chance.
    """
    n, k, m = total.cast("double"), good.cast("double"), drawn.cast("double")
    mean = F.when(n > 0, m * k / n).otherwise(0.0)
    width = F.when(n > 1, F.sqrt(mean * (1 - k / n) * (n - m) / (n - 1))).otherwise(0.0) * 10 + 3
    low = F.greatest(F.lit(0), total * 0, drawn - (total - good), F.floor(mean - width).cast("long"))
    high = F.least(good, drawn, F.ceil(mean + width).cast("long"))
    log_first = lambda x: (
        log_factorial(good) - log_factorial(x) - log_factorial(good - x) + log_factorial(total - good) - log_factorial(drawn - x)
        - log_factorial(total - good - drawn + x) - log_factorial(total) + log_factorial(drawn) + log_factorial(total - drawn))

    def search(lo: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            term = F.when(x == lo, F.exp(log_first(lo))).otherwise(
                acc["term"] * (good - x + 1) * (drawn - x + 1) / (x * (total - good - drawn + x)))
            return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"),
                            F.when(acc["sum"] < uniform, x).otherwise(acc["at"]).alias("at"))

        start = F.struct(F.lit(0.0).alias("term"), F.lit(0.0).alias("sum"), lo.alias("at"))
        return F.aggregate(F.sequence(lo, F.greatest(lo, high)), start, step, lambda acc: acc["at"])

    return bound(low, search)
