"""Exact quantiles in two reads that never gather a group into one task.

``percentile`` keeps every distinct value of a group in one aggregation buffer. Here a first aggregate builds a
mergeable sketch per key, whose quantiles a little below and above each wanted rank are brackets. A second read counts
what lies outside the brackets and keeps the values inside, reduced map-side; exact ranks come from those counts, and
only the small pieces of a bracket that hold a wanted rank are ordered. The brackets, one row per key, are written when
a quantile is built: sketches draw at random, so a repeated task would get others.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from strataframe.functions.binning import entries_below
from strataframe.sources.tables import scratch_dir

#: Size parameter of the sketches; their rank error is 0.0007 at 99 % confidence, at most some 100 KB a key.
SKETCH_K = 4096
#: Half width of a bracket as a share of the rows: seven times that error, so a miss is out of the question (and is refused).
SLACK = 0.005
#: Pieces of a bracket at sketch quantiles, and equal widths of each piece.
PIECES, WIDTHS = 8, 64
#: Parts of a hot key when rows meet their key's brackets.
SALTS = 16


def _bracket_ranks(probs: Sequence[float]) -> tuple[list[float], list[int]]:
    """Ranks (0 to 1) of the bracket edges, and the segments (i: from edge i - 1 to edge i) that lie in a bracket."""
    step = 2 * SLACK / PIECES
    inside = {round((p - SLACK + i * step) / step) for p in probs for i in range(PIECES)}
    ranks = sorted({0.0, 1.0} | {min(max(i * step, 0.0), 1.0) for c in inside for i in (c, c + 1)})
    middles = [(a + b) / 2 for a, b in zip(ranks, ranks[1:])]
    return ranks, [i for i, m in enumerate(middles, start=1) if int(m // step) in inside]


def _same(columns: Sequence[str], prefix: str) -> Column:
    # Null-safe on every column: an inferred filter would tell two reads of one shuffle apart.
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in columns])


def _bracketed(src: DataFrame, by: Sequence[str], ranks: Sequence[float], carry: Sequence[Column]) -> DataFrame:
    """Rows of ``src`` with ``__s``: the edges of their key, whether all of it is bracket, and what is carried."""
    finite = F.when(~F.isnan("__v") & (F.abs("__v") < float("inf")), F.col("__v"))
    n, m = F.count(F.lit(1)), F.count(finite)
    sketch = F.kll_sketch_agg_double(finite, SKETCH_K)
    per_key = src.groupBy(*by).agg(n.alias("__n"), m.alias("__m"), sketch.alias("__k"), *[c.alias("__c") for c in carry])
    edges = F.when(F.col("__m") > 0, F.kll_sketch_get_quantile_double("__k", F.array(*map(F.lit, ranks)))).otherwise(
        F.array_repeat(F.lit(0.0), len(ranks)))
    # The ranks of a small group shift by more than the slack; so do those among many infinite values or NaN.
    every = (F.col("__n") <= SKETCH_K) | (F.col("__n") - F.col("__m") > F.col("__m") * (SLACK / 4))
    s = F.struct(edges.alias("e"), every.alias("every"), *[F.col("__c").alias("carry") for _ in carry]).alias("__s")
    found = per_key.select(*[F.col(k).alias(f"__b_{k}") for k in by], s)
    path = scratch_dir(src.sparkSession)
    found.write.parquet(path)
    written = src.sparkSession.read.schema(found.schema).parquet(path)
    if not by:
        return src.withColumn("__s", written.scalar())
    brackets = written.withColumn("__b___salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = src.withColumn("__salt", F.pmod(F.xxhash64("__v"), F.lit(SALTS)).cast("int"))
    return salted.join(brackets, _same([*by, "__salt"], "__b_")).select(*by, "__v", "__s")


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], *, by: Sequence[str] = (),
    names: Sequence[str] | None = None, n_name: str | None = None, carry: dict[str, Column] | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles (h = (n-1)p) per key; null values are left out, NaN is the largest value.

    ``names`` are the output columns, ``q_0`` ... by default; ``n_name`` adds the number of values. ``carry`` adds
    aggregates of ``value`` (named ``__v`` there), worked out in the first read. Without keys and without values there is no row.
    """
    names = list(names or [f"q_{i}" for i in range(len(probs))])
    src = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"))
    ranks, inside = _bracket_ranks(probs)
    last = len(ranks)
    carried = [F.struct(*[c.alias(k) for k, c in carry.items()])] if carry else []
    placed = _bracketed(src, by, ranks, carried)

    # Zones rise with the value: 2i + 1 is the value of edge i, 2i the open segment below it.
    edge = F.coalesce(F.get("__s.e", "__below") == F.col("__v"), F.lit(False))
    zone = F.col("__below") * 2 + edge.cast("int")
    lo, hi = F.get("__s.e", F.col("__below") - 1) / 2, F.get("__s.e", "__below") / 2
    width = F.least(F.greatest(F.floor((F.col("__v") / 2 - lo) / (hi - lo) * WIDTHS), F.lit(0)), F.lit(WIDTHS - 1)).cast("int")
    # Below the least and above the largest finite value there are at most two values: they are kept, too.
    # Looked up by zone: a long IN list would keep the two reads below from sharing one shuffle.
    always = [z % 2 == 1 or z // 2 in (0, *inside, last) for z in range(2 * last + 1)]
    kept = F.col("__s.every") | F.get(F.array(*map(F.lit, always)), "__zone")
    cut = (F.col("__zone") % 2 == 0) & F.col("__zone").between(2, 2 * last - 2) & kept
    extra = [F.col("__s.carry").alias("__c")] if carry else []
    cells = (
        placed.withColumn("__below", entries_below(F.col("__v"), F.col("__s.e"), last)).withColumn("__zone", zone)
        .select(*by, "__zone", F.when(cut, width).otherwise(0).alias("__fine"), F.when(kept, F.col("__v")).alias("__at"), *extra)
        # What is carried is a key: an aggregate would be pruned where it is not used, and the shuffle not be read twice.
        .groupBy(*by, "__zone", "__fine", "__at", *["__c"][:len(extra)]).agg(F.count(F.lit(1)).alias("__n"))
    )

    place = [*by, "__zone", "__fine"]
    sizes = cells.groupBy(*place).agg(F.sum("__n").alias("__bn"))
    # Without keys the window holds the pieces of one table, whose number is fixed by ``probs``.
    running = Window.partitionBy(*by).orderBy("__zone", "__fine").rowsBetween(Window.unboundedPreceding, 0)
    located = sizes.select(
        *place,
        F.sum("__bn").over(Window.partitionBy(*by)).alias("__total"),
        (F.sum("__bn").over(running) - F.col("__bn")).alias("__before"),
        F.sum("__bn").over(running).alias("__upto"),
    )
    position = [(F.col("__total") - 1) * F.lit(float(p)) for p in probs]
    wanted_ranks = [r.cast("long") for h in position for r in (F.floor(h), F.ceil(h))]
    hit = reduce(lambda a, b: a | b, [(r >= F.col("__before")) & (r < F.col("__upto")) for r in wanted_ranks])
    wanted = located.where(hit).select(*[F.col(k).alias(f"__w_{k}") for k in place], "__total", "__before")
    inner = Window.partitionBy(*place).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    ranked = cells.join(wanted, _same(place, "__w_")).withColumn("__hi", F.col("__before") + F.sum("__n").over(inner))
    covers = [(r < F.col("__hi")) & (r >= F.col("__hi") - F.col("__n")) for r in wanted_ranks]
    missed = F.lit("a sketch missed a quantile by more than its bracket")
    picked = ranked.groupBy(*by).agg(
        F.first("__total").alias("__total"), *[F.first("__c").alias("__c") for _ in extra],
        *[F.max(F.when(c, F.coalesce("__at", F.raise_error(missed).cast("double")))).alias(f"__r{i}") for i, c in enumerate(covers)],
    )
    picked = picked.where(F.col("__total") > 0)
    out = []
    for i, (h, name) in enumerate(zip(position, names)):
        below, above = F.col(f"__r{2 * i}"), F.col(f"__r{2 * i + 1}")
        # Between two equal infinite values there is nothing to interpolate.
        out.append(F.when(below == above, below).otherwise(below + (above - below) * (h - F.floor(h))).alias(name))
    if n_name:
        out.append(F.col("__total").alias(n_name))
    return picked.select(*by, *out, *[F.col(f"__c.{k}").alias(k) for k in carry or ()])


def reorder_by_median(df: DataFrame, key: str, value: str, *, out: str = "ord") -> DataFrame:
    """Position of each label when labels are sorted by the median of ``value``."""
    from strataframe.operators.ranking import global_row_number

    medians = exact_quantiles(df, value, [0.5], by=[key], names=["median"])
    return global_row_number(medians, ["median", key], out)
