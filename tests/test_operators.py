import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import FOUR, rows
from strataframe.plans import reports
from strataframe.operators import aggregates as agg, captures, density, draws, joins, quantiles, ranking, regression, reshape


def test_null_keys_join(spark):
    a = spark.createDataFrame([(1, "a"), (None, "b")], "k int, x string")
    b = spark.createDataFrame([(1, "p"), (None, "q"), (3, "r")], "k int, y string")
    assert rows(joins.nullsafe_join(a, b, ["k"])) == [(None, "b", "q"), (1, "a", "p")]
    assert rows(joins.nullsafe_join(a, b, ["k"], "full")) == [(None, "b", "q"), (1, "a", "p"), (3, None, "r")]
    with pytest.raises(ValueError):
        joins.nullsafe_join(a, b.withColumn("x", F.lit(1)), ["k"])


def test_membership_and_counts(spark):
    names = spark.createDataFrame([("a",), ("b",), (None,)], "n string")
    occ = spark.createDataFrame([("a",)] * 3 + [("c",)], "m string")
    assert rows(joins.membership_flag(names, "n", occ, "m", yes="y", no="n", out="f")) == [
        (None, "n"), ("a", "y"), ("b", "n")]
    assert rows(joins.count_by_name(names, "n", occ, "m")) == [(None, 0), ("a", 3), ("b", 0)]
    doubled = names.unionAll(names)
    assert joins.members_only(doubled, "n", occ, "m").count() == 2


def test_spread_join_keeps_every_row(spark):
    left = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 3 > 0, "hot").when(
        F.col("id") % 5 == 0, None).otherwise(F.col("id").cast("string")).alias("k"))
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("3", 3), (None, 4)], "k string, g int")
    want = rows(joins.nullsafe_join(left, right, ["k"]), "id", "k", "g")
    assert rows(joins.spread_left_join(left, right, "k"), "id", "k", "g") == want


def test_spread_join_does_not_repeat_the_right_side(spark):
    left = spark.range(100).selectExpr("cast(id % 7 as string) as k", "id")
    joined = joins.spread_left_join(left, spark.range(7).selectExpr("cast(id as string) as k", "id as g"), "k")
    # A broadcast of copies takes as many times the memory in every task.
    assert "Generate" not in joined._jdf.queryExecution().optimizedPlan().toString()
    assert joined.where(F.col("g") == F.col("k").cast("long")).count() == 100


def test_interval_join_matches_tree(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 5, 10, 10.5, 20, 30, 39, 40, 41)], "x double")
    got = joins.interval_join(df, "x", FOUR.to_df(spark), "top", "bottom", width=7.0, include_lowest=True)
    assert rows(got, "x", "stg") == [
        (0.0, 4), (5.0, 4), (10.0, 4), (10.5, 3), (20.0, 3), (30.0, 2), (39.0, 1), (40.0, 1), (41.0, None)]


def test_strict_aggregates(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2), ("b", 3)], "k string, x int")
    got = df.groupBy("k").agg(*[f(F.col("x")).alias(f.__name__) for f in (agg.strict_max, agg.strict_min, agg.strict_avg, agg.strict_sum)])
    assert rows(got) == [("a", None, None, None, None), ("b", 3, 2, 2.5, 5)]


def test_all_true(spark):
    df = spark.createDataFrame([("a", True), ("a", None), ("b", False), ("b", None), ("c", True)], "k string, x boolean")
    assert rows(df.groupBy("k").agg(agg.all_true(F.col("x")).alias("all"))) == [("a", None), ("b", False), ("c", True)]


def test_null_shares_use_different_totals(spark):
    df = spark.createDataFrame([("a", None), ("a", 1), ("b", None), ("b", None)], "g string, x int")
    assert rows(agg.null_percent_of_table(df, "g", ["x"])) == [("a", 25.0), ("b", 50.0)]
    assert rows(agg.null_percent_of_subset(df.where("g = 'a'"), ["x"])) == [(50.0,)]
    assert rows(agg.null_percent_of_subset(df.where("g = 'z'"), ["x"])) == [(None,)]


def test_shares(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 3), (None, "z", 4)], "g string, v string, n int")
    assert rows(agg.share_of_total(df, "n", "p"), "v", "p") == [("x", 12.5), ("y", 37.5), ("z", 50.0)]
    assert rows(agg.share_within(df, ["g"], "n", "p"), "v", "p") == [("x", 25.0), ("y", 75.0), ("z", 100.0)]


def test_reshape(spark):
    df = spark.createDataFrame([("c1", "Paleozoic", 3.0), ("c2", "Cenozoic", 4.0)], "clade string, era string, s double")
    full = reshape.complete(df, "clade", "era", ["Paleozoic", "Mesozoic", "Cenozoic"], {"s": 0.0})
    assert rows(full)[:3] == [("c1", "Cenozoic", 0.0), ("c1", "Mesozoic", 0.0), ("c1", "Paleozoic", 3.0)]
    assert full.count() == 6
    r = spark.createDataFrame([(3, 3), (3, 5), (None, 2)], "lo int, hi int")
    assert rows(reshape.expand_range(r, "lo", "hi", "b"), "lo", "b") == [(3, 3), (3, 3), (3, 4), (3, 5)]
    with pytest.raises(Exception, match="reversed range"):
        reshape.expand_range(spark.createDataFrame([(5, 3)], "lo int, hi int"), "lo", "hi", "b").collect()
    counts = spark.createDataFrame([("g", "yes"), ("h", "no")], "g string, k string")
    assert rows(reshape.pivot_counts(counts, ["g"], "k", ["no", "yes"], zero_fill=["no"])) == [
        ("g", 0, 1), ("h", 1, None)]
    wide = spark.createDataFrame([(1, None, "x")], "i int, a string, b string")
    assert rows(reshape.unpivot(wide, ["i"], ["a", "b"], "k", "v")) == [(1, "a", None), (1, "b", "x")]
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([("q",)], "y string")
    assert rows(reshape.stack(a, b)) == [(None, "q"), (1, None)]


def test_presence_matrix_and_lists(spark):
    seen = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "t string, b int")
    assert rows(reshape.presence_matrix(seen, ["t"], "b", [1, 2, 3])) == [("a", 1, 0, 1), ("b", 0, 1, 0)]
    d = spark.createDataFrame([(1, "x", 2, 20.0), (1, "x", 1, 10.0), (1, "y", 1, 5.0)], "k int, s string, d int, v double")
    assert rows(reshape.pivot_lists(d, ["k"], "s", ["x", "y"], "v", "d"))[0] == (1, [10.0, 20.0], [5.0])
    with pytest.raises(ValueError):
        reshape.pivot_lists(d, ["k"], "s", ["x", "y"], "v", "d", max_cell=1)


def test_blank_repeats(spark):
    df = spark.createDataFrame([("g", 1), ("g", 2), ("h", 1)], "g string, o int")
    assert rows(reshape.blank_repeats(df, "g", ["o"])) == [("", 2), ("g", 1), ("h", 1)]


def test_leaders_keep_ties(spark):
    df = spark.createDataFrame([("c", 5.0, "P"), ("c", 5.0, "M"), ("c", 1.0, "C"), ("d", None, "P"), ("d", 2.0, "M")],
                               "clade string, s double, era string")
    assert rows(ranking.leaders(df, ["clade"], "s"), "clade", "era") == [("c", "M"), ("c", "P")]


def test_top_k_cuts_ties_by_key(spark):
    df = spark.createDataFrame([("b", 2.0), ("a", 2.0), ("c", 9.0), ("d", None)], "t string, r double")
    assert [r.t for r in ranking.top_k(df, 2, "r", ["t"]).collect()] == ["c", "a"]
    assert [r.t for r in ranking.top_k(df, 4, "r", ["t"]).collect()][-1] == "d"


def skewed(spark, n=20000):
    """A third of the rows share one key and one value."""
    return spark.range(n).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 11 == 0, None).otherwise(
            F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("k"),
        F.when(F.col("id") % 3 == 0, 1.5).otherwise((F.xxhash64("id") % 1000) / 7.0).alias("v"),
    )


def test_row_numbers_match_sorting(spark):
    df = skewed(spark)
    got = ranking.global_row_number(df, ["v", "id"], "n").select("id", "v", "n").collect()
    want = sorted(got, key=lambda r: (r.v, r.id))
    assert [r.n for r in want] == list(range(1, len(got) + 1))
    keyed = ranking.keyed_row_number(df, ["k"], ["v", "id"], "n").collect()
    for _, members in itertools.groupby(sorted(keyed, key=lambda r: (str(r.k), r.v, r.id)), key=lambda r: r.k):
        assert [r.n for r in members] == list(range(1, sum(1 for r in keyed if r.k == _) + 1))


def test_row_numbers_of_awkward_keys(spark):
    df = spark.createDataFrame([('q"uo\\te', 1), (None, 2), ("é\n", 3), ("", 4)], "s string, i int")
    got = {r.s: r.n for r in ranking.global_row_number(df, ["s"], "n").collect()}
    assert got[None] == 1 and got[""] == 2 and sorted(got.values()) == [1, 2, 3, 4]


def test_quantiles_match_numpy(spark):
    probs = [0.0, 0.025, 0.17, 0.5, 0.83, 0.975, 1.0]
    df = skewed(spark).withColumn("v", F.when(F.col("id") % 17 != 0, F.col("v")))
    got = {r[0]: r for r in quantiles.exact_quantiles(df, "v", probs, by=["k"], n_name="n").collect()}
    data = {}
    for r in df.collect():
        if r.v is not None:
            data.setdefault(r.k, []).append(r.v)
    assert set(got) == set(data)
    for k, values in data.items():
        assert list(got[k][1:-1]) == pytest.approx(list(np.quantile(values, probs)))
        assert got[k].n == len(values)
    whole = quantiles.exact_quantiles(df, "v", [0.5], names=["m"]).first().m
    assert whole == pytest.approx(np.median([v for vs in data.values() for v in vs]))


def test_quantiles_of_tiny_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 1.0), ("c", 2.0)], "k string, v double")
    assert rows(quantiles.exact_quantiles(df, "v", [0.25], by=["k"])) == [("a", 1.0), ("c", 1.25)]


def test_quantiles_of_large_groups_and_ties(spark):
    # Well beyond the size below which all of a group is bracket; a fifth of the rows share one value.
    df = spark.range(60000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 2).cast("string")).alias("k"),
                                   F.when(F.col("id") % 5 == 0, 2.5).otherwise(F.exp(F.sin("id") * 9)).alias("v")).persist()
    probs = [0.0, 0.001, 0.17, 0.5, 0.503, 0.975, 1.0]
    data = df.toPandas()
    for r in quantiles.exact_quantiles(df, "v", probs, by=["k"]).collect():
        assert list(r[1:]) == pytest.approx(list(np.quantile(data.v[data.k == r.k], probs)), rel=1e-12)
    whole = quantiles.exact_quantiles(df, "v", probs, n_name="n", carry={"top": F.max("__v")}).first()
    assert list(whole[:-2]) == pytest.approx(list(np.quantile(data.v, probs)), rel=1e-12)
    assert (whole.n, whole.top) == (60000, data.v.max())


def test_quantiles_of_infinite_values_and_empty_tables(spark):
    inf = float("inf")
    df = spark.createDataFrame([(1, float("nan")), (2, None), (3, inf), (3, 1.0), (3, -inf), (4, inf), (4, inf)], "k int, v double")
    got = {r[0]: r[1:] for r in quantiles.exact_quantiles(df, "v", [0.0, 0.5, 1.0], by=["k"]).collect()}
    assert set(got) == {1, 3, 4} and all(map(math.isnan, got[1]))
    assert got[3] == (-inf, 1.0, inf) and got[4] == (inf, inf, inf)
    assert quantiles.exact_quantiles(df.where("k = 2"), "v", [0.5]).count() == 0


def test_quantiles_read_their_input_once_after_the_brackets(spark, tmp_path):
    path = str(tmp_path / "v")
    spark.range(1000).select((F.col("id") % 3).alias("k"), F.rand(1).alias("v")).write.parquet(path)
    got = quantiles.exact_quantiles(spark.read.parquet(path), "v", [0.025, 0.17, 0.5, 0.83, 0.975], by=["k"])
    got.collect()
    # One scan is of the brackets; the counts and the candidates share a shuffle.
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert plan.count("FileScan") == 2 and "ReusedExchange" in plan


def test_density_matches_direct_sum(spark):
    df = skewed(spark, 2000).where("k is not null")
    bw = {r.k: r for r in density.bandwidths(df, "v", ["k"]).collect()}
    out = density.kernel_density(df, "v", ["k"], grid=4096, out_points=64).collect()
    data = {}
    for r in df.collect():
        data.setdefault(r.k, []).append(r.v)
    for k, values in data.items():
        v, curve = np.array(values), sorted((r.x, r.density) for r in out if r.k == k)
        q1, q3 = np.quantile(v, [0.25, 0.75])
        sd = v.std(ddof=1)
        spread = min(sd, (q3 - q1) / 1.34) or sd or abs(v.min()) or 1
        assert bw[k].bw == pytest.approx(0.9 * spread * len(v) ** -0.2)
        h = bw[k].bw
        exact = [np.exp(-0.5 * ((x - v) / h) ** 2).sum() / (len(v) * h * math.sqrt(2 * math.pi)) for x, _ in curve]
        # The constant group has a bandwidth of only a few axis steps.
        assert [d for _, d in curve] == pytest.approx(exact, abs=(2e-2 if k == "hot" else 1e-3) * max(exact))


def test_density_by_reach(spark):
    # Two tight heaps far apart, a key without a heap nearby, values that are no numbers.
    df = spark.createDataFrame(
        [("a", float(v % 7)) for v in range(70)] + [("b", 1e6 + v % 5) for v in range(50)]
        + [("a", float("nan")), ("b", float("inf")), ("b", None), ("c", 3.0), (None, 5.0), (None, 6.0)], "k string, v double")
    got = density.kernel_density(df, "v", ["k"], grid=256, out_points=33)
    curves = {}
    for r in got.collect():
        curves.setdefault(r.k, {})[r.point] = (r.x, r.density)
    assert set(curves) == {"a", "b", None} and all(sorted(c) == list(range(33)) for c in curves.values())
    assert curves["a"][0][0] == 0.0 and curves["a"][32][0] == 1e6 + 4
    # What lies out of reach adds exactly nothing.
    assert curves["a"][16][1] == curves["a"][32][1] == curves["b"][0][1] == 0.0
    assert curves["a"][0][1] > 0 and curves["b"][32][1] > 0


def test_density_reads(spark, tmp_path):
    spark.range(4000).selectExpr("id % 3 as k", "sqrt(id) as v").write.parquet(str(tmp_path / "t"))
    got = density.kernel_density(spark.read.parquet(str(tmp_path / "t")), "v", ["k"], out_points=16)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # The rows are read once more; the other relations are the written bandwidths.
    relations = [line for line in plan.splitlines() if "Relation [" in line]
    assert sum("bw#" not in line for line in relations) == 1


def test_density_works_its_rows_out_once(spark):
    df = spark.range(4000).selectExpr("id % 3 as k", "sqrt(id) as v")
    got = density.kernel_density(df, "v", ["k"], out_points=16)
    # What is left to do reads written rows, not what they are made from.
    assert "Range (" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.count() == 3 * 16


def test_density_mass_and_bound(spark):
    df = spark.range(3000).select(F.lit("g").alias("g"), F.abs(F.randn(seed=5)).alias("v"))
    curve = sorted((r.x, r.density) for r in density.kernel_density(df, "v", ["g"], lower_bound=0.0).collect())
    xs, ds = zip(*curve)
    assert xs[0] == 0.0
    # Only the tail beyond the largest value is missing.
    assert np.trapezoid(ds, xs) == pytest.approx(1, abs=5e-3)


def test_least_squares(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 10, 200)
    y = 0.5 + 0.3 * x + rng.normal(0, 1, 200)
    df = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(x, y)] + [("h", 1.0, 2.0), ("h", 2.0, 4.0), ("i", 1.0, 1.0)],
                               "k string, x double, y double")
    fits = {r.k: r for r in regression.with_inference(regression.least_squares(df, "y", "x", ["k"])).collect()}
    b, a = np.polyfit(x, y, 1)
    resid = y - a - b * x
    se = math.sqrt((resid @ resid) / 198 / ((x - x.mean()) ** 2).sum())
    g = fits["g"]
    assert (g.slope, g.intercept, g.se) == (pytest.approx(b), pytest.approx(a), pytest.approx(se))
    assert g.upper - g.lower == pytest.approx(2 * 1.972017 * se, rel=1e-5)
    assert fits["h"].slope == pytest.approx(2.0) and fits["h"].se is None and fits["h"].p_value is None
    assert fits["i"].slope is None


def test_trend_table_format(spark):
    rng = np.random.default_rng(2)
    data = [("g", float(x), float(0.01 * x + rng.normal(0, 0.2))) for x in range(40)]
    df = spark.createDataFrame(data, "group string, x double, y double")
    got = {r["group"]: r for r in regression.trend_table(df, "y", "x", "group").collect()}
    assert set(got) == {"Overall", "g"} and list(got["g"].asDict()) == ["group", "mean_trend", "p_star", "CI"]
    number = r"-?\d+(\.\d)?%"
    assert __import__("re").fullmatch(number, got["g"].mean_trend)
    assert __import__("re").fullmatch(rf"\[{number}, {number}\]", got["g"].CI)


def test_logistic_two_by_two(spark):
    cells = spark.createDataFrame([(1, 1, 30), (1, 0, 70), (0, 1, 10), (0, 0, 90)], "g int, y int, n int")
    fit = {r.term: r for r in regression.logistic_fit(cells, "y", "n", [("g", F.col("g"))]).collect()}
    assert fit["g"].estimate == pytest.approx(math.log(30 * 90 / (70 * 10)), abs=1e-6)
    assert fit["g"].se == pytest.approx(math.sqrt(1 / 30 + 1 / 70 + 1 / 10 + 1 / 90), rel=1e-5)
    assert fit["(Intercept)"].estimate == pytest.approx(math.log(10 / 90), abs=1e-6)
    with pytest.raises(regression.ConstantResponse):
        regression.logistic_fit(cells.where("y = 1"), "y", "n", [("g", F.col("g"))])


def _firth(ones, zeros):
    """Log odds and variance of one cell of a saturated penalised fit: half a row more on both sides."""
    return math.log((ones + 0.5) / (zeros + 0.5)), (ones + zeros + 1) ** 2 / ((ones + zeros) * (ones + 0.5) * (zeros + 0.5))


def test_separated_logistic_is_finite_and_flagged(spark):
    # Every row of "b" answers 1 and no row of "c": the likelihood has no maximum.
    cells = spark.createDataFrame(
        [("a", 1, 12), ("a", 0, 28), ("b", 1, 200), ("b", 0, 0), ("c", 0, 9), ("d", 1, 5), ("d", 0, 5)], "g string, y int, n int")
    terms = [(f"g{v}", (F.col("g") == v).cast("double")) for v in "bcd"]
    fit = {r.term: r for r in regression.logistic_fit(cells, "y", "n", terms).collect()}
    assert {r.fit for r in fit.values()} == {"penalised"}
    assert {t for t, r in fit.items() if r.separated} == {"gb", "gc"}
    base, var = _firth(12, 28)
    for name, (ones, zeros) in {"gb": (200, 0), "gc": (0, 9), "gd": (5, 5)}.items():
        est, v = _firth(ones, zeros)
        assert fit[name].estimate == pytest.approx(est - base, abs=1e-6)
        assert fit[name].se == pytest.approx(math.sqrt(v + var), rel=1e-6)
    assert fit["gb"].p < 1e-4 and fit["gd"].p > 0.05
    # So the flag "no term matters" does not turn true by separation.
    assert not reports.all_above(regression.logistic_fit(cells, "y", "n", terms)).first().is_mar


def test_separation_by_no_single_term(spark):
    # The baseline alone answers 0 throughout, which no term shows: the search for a maximum does not end.
    cells = spark.createDataFrame([("a", 0, 30), ("b", 1, 6), ("b", 0, 4), ("c", 1, 3), ("c", 0, 7)], "g string, y int, n int")
    terms = [(f"g{v}", (F.col("g") == v).cast("double")) for v in "bc"]
    fit = {r.term: r for r in regression.logistic_fit(cells, "y", "n", terms).collect()}
    assert {r.fit for r in fit.values()} == {"penalised"} and not any(r.separated for r in fit.values())
    assert fit["(Intercept)"].estimate == pytest.approx(_firth(0, 30)[0], abs=1e-6)
    assert fit["gb"].estimate == pytest.approx(_firth(6, 4)[0] - _firth(0, 30)[0], abs=1e-6)


def test_penalised_slope_against_brute_force(spark):
    # x alone splits the responses. The penalised likelihood is searched on a fine lattice.
    data = [(1.0, 0), (2.0, 0), (3.0, 0), (5.0, 1), (6.0, 1)]
    cells = spark.createDataFrame([(x, y, 1) for x, y in data], "x double, y int, n int")
    fit = {r.term: r for r in regression.logistic_fit(cells, "y", "n", [("x", F.col("x"))]).collect()}
    assert fit["x"].separated and fit["x"].fit == "penalised"

    def goal(a, b):
        q = [1 / (1 + math.exp(-a - b * x)) for x, _ in data]
        v = [p * (1 - p) for p in q]
        det = sum(v) * sum(w * x * x for w, (x, _) in zip(v, data)) - sum(w * x for w, (x, _) in zip(v, data)) ** 2
        return sum(math.log(p if y else 1 - p) for p, (_, y) in zip(q, data)) + 0.5 * math.log(det)

    a, b = fit["(Intercept)"].estimate, fit["x"].estimate
    near = [goal(a + da * 1e-3, b + db * 1e-3) for da in range(-3, 4) for db in range(-3, 4)]
    assert goal(a, b) == max(near) and goal(a, b) >= max(goal(i / 4, j / 8) for i in range(-60, 1) for j in range(0, 40))


def test_logistic_terms_without_variation_and_missing_cells(spark):
    cells = spark.createDataFrame([(1, 1, 30), (1, 0, 70), (0, 1, 10), (0, 0, 90), (None, 1, 50)], "g int, y int, n int")
    terms = [("g", F.col("g")), ("never", F.lit(0))]
    fit = {r.term: r for r in regression.logistic_fit(cells, "y", "n", terms).collect()}
    assert fit["never"].estimate is None and fit["never"].p is None
    assert fit["g"].estimate == pytest.approx(math.log(30 * 90 / (70 * 10)), abs=1e-6) and fit["g"].fit == "likelihood"


def test_contrasts_need_both_sides(spark):
    d = spark.createDataFrame([("a", "baseline", 1, 3.0), ("a", "megafauna", 1, 1.0), ("a", "baseline", 2, 9.0),
                               ("b", "baseline", 1, 5.0)], "g string, s string, draw int, v double")
    got = draws.contrast_draws(d, "v", ["g"], "s", "baseline", "megafauna")
    assert rows(got) == [("a", 1, 2.0)]


def test_recaptures(spark):
    seen = spark.createDataFrame([("a", 1), ("a", 3), ("a", 3), ("b", 1), ("b", 2)], "t string, bin int")
    assert rows(captures.recapture_array(seen, "t", "bin")) == [(1, 2, 1), (1, 3, 1), (2, None, 1), (3, None, 1)]
    assert rows(captures.sampling_rate(seen, "t", "bin"), "bin", "seen", "ranging") == [(1, 2, 2), (2, 1, 2), (3, 1, 1)]
