"""Histograms and Gaussian kernel densities as aggregates over a fixed grid."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from strataframe.functions.binning import histogram_bin
from strataframe.operators.quantiles import exact_quantiles
from strataframe.sources.tables import written

GRID = 512
#: Bandwidths beyond which a cell adds nothing: the kernel there is 3e-18 of its peak, less than a double resolves.
REACH = 9.0
#: Parts of a hot key when rows meet their key's axis.
SALTS = 16


def histogram(df: DataFrame, value: str, width: float, *, out: str = "bin", n: str = "n") -> DataFrame:
    """Counts per bin centred on multiples of ``width``; null values have no bin."""
    bins = df.where(F.col(value).isNotNull()).select(histogram_bin(F.col(value), width).alias(out))
    return bins.groupBy(out).agg(F.count(F.lit(1)).alias(n))


def bandwidths(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Per key: n, range and the rule-of-thumb bandwidth 0.9 min(sd, IQR/1.34) n^(-1/5).

    A zero spread falls back to the standard deviation, then to the magnitude of
    the data, then to 1. A single value has a null bandwidth.
    """
    moments = {"n": F.count(F.lit(1)), "lo": F.min("__v"), "hi": F.max("__v"), "__sd": F.stddev_samp("__v")}
    found = exact_quantiles(df, value, [0.25, 0.75], by=by, names=["__q1", "__q3"], carry=moments)
    spread = F.least("__sd", (F.col("__q3") - F.col("__q1")) / 1.34)
    positive = lambda c: F.when(c > 0, c)
    scale = F.coalesce(positive(spread), positive(F.col("__sd")), positive(F.abs("lo")), F.lit(1.0))
    bw = F.when(F.col("n") > 1, 0.9 * scale * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    return found.select(*by, "n", "lo", "hi", bw.alias("bw"))


def kernel_density(
    df: DataFrame, value: str, by: Sequence[str], *, grid: int = GRID, out_points: int | None = None,
    lower_bound: float | None = None,
) -> DataFrame:
    """Density per key on ``out_points`` points spanning the data of all keys.

    Linear binning on a ``grid``-point axis reaching four bandwidths beyond the
    range, Gaussian smoothing of the binned weights, linear interpolation between
    axis points. Keys and values are written once and read three times: twice for the bandwidths, one row per key,
    which are written, too, and once to be placed in cells, at most ``grid`` per key, by a partial aggregate. A cell
    only meets the output points in its ``REACH``. ``lower_bound`` folds the mass below it back. A key
    with a single value has no curve; values that are null, NaN or infinite are left out.
    """
    points = out_points or grid
    number = F.col(value).cast("double")
    rows = written(df.where(F.abs(number) < float("inf")).select(*by, number.alias("__x")))
    bw = written(bandwidths(rows, "__x", by))
    start = bw.agg(F.min("lo")).scalar() if lower_bound is None else F.lit(float(lower_bound))
    stop = bw.agg(F.max("hi")).scalar()
    keys = [F.col(k).alias(f"__a_{k}") for k in by]
    axis = bw.where(F.col("bw").isNotNull()).select(*keys, "n", "bw", start.alias("__from"), stop.alias("__to"))
    axis = axis.withColumn("__lo", F.col("__from") - 4 * F.col("bw"))
    axis = axis.withColumn("__step", (F.col("__to") + 4 * F.col("bw") - F.col("__lo")) / (grid - 1))

    salted = axis.withColumn("__a_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__a_{k}")) for k in by], F.col("__salt") == F.col("__a_salt"))
    pos = (F.col("__x") - F.col("__lo")) / F.col("__step")
    placed = (
        rows.withColumn("__salt", F.pmod(F.xxhash64("__x"), F.lit(SALTS)).cast("int")).join(salted, on)
        .withColumn("__cell", F.floor(pos)).withColumn("__frac", pos - F.floor(pos))
    )
    halves = F.inline(F.array(
        F.struct(F.col("__cell").alias("cell"), (1 - F.col("__frac")).alias("w")),
        F.struct((F.col("__cell") + 1).alias("cell"), F.col("__frac").alias("w")),
    ))
    axis_cols = ["n", "bw", "__from", "__to", "__lo", "__step"]
    binned = placed.select(*by, *axis_cols, halves).groupBy(*by, *axis_cols, "cell").agg(F.sum("w").alias("w"))

    spacing = (F.col("__to") - F.col("__from")) / (points - 1)
    centre = F.col("__lo") + F.col("cell") * F.col("__step")
    reach = REACH * F.col("bw") + F.col("__step")

    def met(middle: Column, folded: bool) -> Column:
        """Output points around ``middle``; all of them where they coincide."""
        def place(at: Column) -> Column:
            p = F.try_divide(at - F.col("__from"), spacing)
            return F.least(F.greatest(p, F.lit(-1.0)), F.lit(float(points)))

        low = F.greatest(F.coalesce(F.ceil(place(middle - reach)).cast("int"), F.lit(0)), F.lit(0))
        high = F.least(F.coalesce(F.floor(place(middle + reach)).cast("int"), F.lit(points - 1)), F.lit(points - 1))
        span = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
        return F.transform(span, lambda p: F.struct(p.alias("point"), F.lit(folded).alias("folded")))

    meetings = met(centre, False)
    if lower_bound is not None:
        meetings = F.concat(meetings, met(2 * F.lit(float(lower_bound)) - centre, True))
    x = F.col("__from") + F.col("point") * spacing
    at = x if lower_bound is None else F.when(F.col("folded"), 2 * F.lit(float(lower_bound)) - x).otherwise(x)
    t = (at - F.col("__lo")) / F.col("__step")
    f = t - F.floor(t)

    def phi(axis_point: Column) -> Column:
        z = (axis_point - F.col("cell")) * F.col("__step") / F.col("bw")
        return F.exp(-0.5 * z * z)

    mass = (1 - f) * phi(F.floor(t)) + f * phi(F.floor(t) + 1)
    norm = F.col("n") * F.col("bw") * math.sqrt(2 * math.pi)
    place = [*by, "__from", "__to", "point"]
    near = binned.select(*by, *axis_cols, "cell", "w", F.inline(meetings)).select(*place, (F.col("w") * mass / norm).alias("__d"))
    # Points out of reach of every cell are there, too.
    empty = axis.select(*[F.col(f"__a_{k}").alias(k) for k in by], "__from", "__to",
                        F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"), F.lit(0.0).alias("__d"))
    return near.unionByName(empty).groupBy(*place).agg(F.sum("__d").alias("density")).select(*by, "point", x.alias("x"), "density")
