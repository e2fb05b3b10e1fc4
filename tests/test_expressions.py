import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import FOUR, rows
from strataframe.functions import binning, categories as cat, numeric, text
from strataframe.operators.regression import stars


def one(spark, values, expr, type_="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {type_}")
    return [r[0] for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_size_class_bounds(spark):
    sizes = [5.0, 5.01, 10.0, 21.0, 21.1, 0.0, None]
    assert one(spark, sizes, binning.size_class) == ["<5m", "5-10m", "5-10m", ">15m", None, None, None]


def test_era_bounds(spark):
    ages = [0.0, 66.04, 66.05, 251.9, 252.0, 538.8, 538.9]
    assert one(spark, ages, binning.era_of_age) == [
        None, "Cenozoic", "Mesozoic", "Mesozoic", "Paleozoic", "Paleozoic", None]


@pytest.mark.parametrize("age, older, younger", [
    (20.0, 3, 3), (10.0, 3, 4), (30.0, 2, 2), (5.0, None, 4), (35.0, 1, None), (41.0, None, None),
    (0.0, None, 4), (40.0, 1, None), (None, None, None),
])
def test_stage_bins(spark, age, older, younger):
    assert one(spark, [age], lambda c: binning.stage_of_older_bound(c, FOUR.bottoms)) == [older]
    assert one(spark, [age], lambda c: binning.stage_of_younger_bound(c, FOUR.tops)) == [younger]


def test_exact_single_stage_is_dropped_unless_left_closed(spark):
    # max 30 and min 20 delimit stage 2 exactly.
    assert one(spark, [30.0], lambda c: binning.stage_of_older_bound(c, FOUR.bottoms)) == [2]
    assert one(spark, [20.0], lambda c: binning.stage_of_younger_bound(c, FOUR.tops)) == [3]
    left = lambda c: binning.stage_of_younger_bound(c, FOUR.tops, closed="left")
    assert one(spark, [20.0, 0.0, 35.0, 19.9, -1.0], left) == [2, 4, 1, 3, None]


def test_cut_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    breaks = sorted(set(np.round(rng.uniform(0, 100, 95), 1)))
    values = [float(v) for v in np.round(rng.uniform(-5, 105, 500), 1)] + [float(b) for b in breaks]

    def brute(v):
        if v == breaks[0]:
            return 1
        return next((i for i, (lo, hi) in enumerate(zip(breaks, breaks[1:]), 1) if lo < v <= hi), None)

    got = one(spark, values, lambda c: binning.cut_index(c, breaks, include_lowest=True))
    assert got == [brute(v) for v in values]
    ages = [v for v, b in zip(values, got) if b]
    stages = one(spark, sorted(ages), lambda c: binning.stage_of_older_bound(c, breaks))
    assert stages == sorted(stages, reverse=True)


def test_breaks_are_checked(spark):
    with pytest.raises(ValueError):
        binning.cut_index(F, [1.0, 1.0, 2.0])
    # Beyond the length of a tree one array is searched.
    found = one(spark, [0.0, 0.5, 1.0, 1999.0, 1234.5, -1.0, None], lambda c: binning.cut_index(c, range(2000)))
    assert found == [None, 1, 1, 1999, 1235, None, None]


def test_histogram_bins_are_centred_and_right_closed(spark):
    assert one(spark, [0.0, 0.5, 0.51, 1.5, 1.6], lambda c: binning.histogram_bin(c, 1.0)) == [0, 0, 1, 1, 2]


def test_names(spark):
    names = ["Otodus ? cf. megalodon (Bar)", "Ridge 12: dig", "Staffia aff. bar", "  A   b ", None]
    assert one(spark, names, text.clean_name, "string") == [
        "Otodus megalodon", "Ridge : dig", "Stia bar", "A b", None]
    assert one(spark, ["Foo spinosus", "Foo sp."], text.strip_open_suffix, "string") == ["Foo spinosus", "Foo"]
    published = lambda c: text.strip_open_suffix(c, as_published=True)
    assert one(spark, ["Foo spinosus", "Foo sp."], published, "string") == ["Foonosus", "Foo"]
    assert one(spark, ["Solo", "A b", "A b c", ""], lambda c: text.genus_and_species(c)[1], "string") == [
        None, "b", "b", None]
    assert one(spark, ["a  b\tc", "", " x "], text.token_count, "string") == [3, 0, 1]
    assert one(spark, ["a b c", "ab", None], lambda c: text.replace_first(c, " ", "%20"), "string") == [
        "a%20b c", "ab", None]


def test_number_text_uses_fewest_digits(spark):
    assert one(spark, [5.0, 1.66, -0.04, 0.0, 10.0, 50.55, -11.1, None], text.number_text) == [
        "5", "1.7", "0", "0", "10", "50.6", "-11.1", "NA"]
    ci = one(spark, [2.5], lambda c: text.interval_text(-c, c * 2))
    assert ci == ["[-2.5%, 5%]"]


def test_categories(spark):
    labels = ["Birds", "Unknown", None]
    assert one(spark, labels, lambda c: cat.level_position(c, cat.GROUPS), "string") == [7, None, None]
    assert one(spark, labels, lambda c: cat.restrict_levels(c, cat.GROUPS), "string") == ["Birds", None, None]
    assert one(spark, ["Bony_fishes", "Birds", None], lambda c: cat.recode(c, cat.GROUP_RECODE), "string") == [
        "Bony fishes", "Birds", None]
    assert one(spark, ["Placoderms", "Birds", None], lambda c: cat.collapse(c, "Fishes", cat.FISHES), "string") == [
        "Fishes", "Birds", None]
    assert cat.with_missing_last(("a", "Missing", "b")) == ("a", "b", "Missing")


def test_stars(spark):
    p = [0.0005, 0.005, 0.03, 0.2, 0.05, None]
    assert one(spark, p, stars) == ["***", "**", "*", "ns", "*", None]
    assert one(spark, p, lambda c: stars(c, as_published=True)) == ["***", "**", None, "ns", None, None]


# Two-sided 5 % and 0.1 % critical values from printed t tables.
@pytest.mark.parametrize("df, tail, t", [
    (1, 0.05, 12.7062), (2, 0.05, 4.3027), (5, 0.05, 2.5706), (10, 0.05, 2.2281), (30, 0.05, 2.0423),
    (120, 0.05, 1.9799), (1, 0.001, 636.619), (10, 0.001, 4.5869), (1e9, 0.05, 1.959964),
])
def test_student_t(spark, df, tail, t):
    got = spark.range(1).select(numeric.t_critical(tail, F.lit(float(df))), numeric.t_p_value(F.lit(t), F.lit(float(df)))).first()
    assert got[0] == pytest.approx(t, abs=6e-4 * max(1, t / 10))
    assert got[1] == pytest.approx(tail, rel=2e-3)


def test_student_t_edges(spark):
    with_dof = lambda n: lambda t: numeric.t_p_value(t, F.lit(n))
    assert one(spark, [0.0, math.inf, -math.inf, math.nan, None], with_dof(3)) == [1.0, 0.0, 0.0, None, None]
    assert one(spark, [1.0], with_dof(0)) == [None] and spark.range(1).select(numeric.t_critical(0.05, F.lit(0))).first()[0] is None
    # One degree of freedom is the Cauchy distribution, two have a closed form.
    for t in (0.1, 1.0, 7.0, 3e5):
        assert one(spark, [t, -t], with_dof(1)) == pytest.approx([1 - 2 * math.atan(t) / math.pi] * 2, rel=1e-9)
        assert one(spark, [t], with_dof(2)) == pytest.approx([1 - t / math.sqrt(2 + t * t)], rel=1e-8, abs=1e-15)


def test_student_t_tail_inverts(spark):
    for n in (1, 2, 3, 7, 40, 1000, 10**6):
        for tail in (0.5, 0.05, 1e-3, 1e-6):
            q = spark.range(1).select(numeric.t_critical(tail, F.lit(n)).alias("t")).select(numeric.t_p_value(F.col("t"), F.lit(n))).first()[0]
            assert q == pytest.approx(tail, rel=1e-8)


def test_normal_tail(spark):
    z = [0.0, 1e-9, 0.5, 1.959964, 4.2, 4.3, -6.0, 30.0, math.inf]
    assert one(spark, z, numeric.normal_p_value) == pytest.approx([math.erfc(abs(v) / math.sqrt(2)) for v in z], rel=1e-9)
    assert one(spark, [None, math.nan], numeric.normal_p_value) == [None, None]


def test_bad_numbers_become_null(spark):
    df = spark.createDataFrame([(["2.5"],), (["abc"],), ([],), (None,)], "v array<string>")
    got = rows(df.select(F.explode("v").alias("v")).select(F.col("v").try_cast("double")))
    assert got == [(None,), (2.5,)]
