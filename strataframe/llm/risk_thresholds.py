"""Quality rules whose cutoffs carry a guarantee on false rejections, with DataFrame functions only.

Each rule is a number per document that grows with what the rule dislikes; a document is rejected if any rule's value is over its
cutoff. A fifth of the good labelled documents, the proposals, gives each stratum and rule a middle (the median) and a spread (from there to
the 0.99 quantile, and not below that of all strata together); a candidate is one multiple of the spread, shared by all rules of the stratum.
The other four fifths, the holdout, test the candidates from the loosest on, each as the one rejection it makes by all rules
together: it passes when the exact binomial probability of as few rejected good documents as were seen, if the true rate were the limit, is at
most the level; the strictest candidate before the first failure is taken. Testing in a fixed order needs no correction within a
stratum; across strata the level is divided by their number (Bonferroni), counting those whose holdout could pass at all, which depends on its
size only. So with probability 1 - ``level``, in every stratum at most ``limit`` of the good documents that pass the base rules are rejected by
the others. A stratum without enough labels gets no cutoff: with four strata and the limit 0.02 it takes 217 good holdout documents, none of
them rejected.

Defined results: a null text is empty and fails the base rules; a null stratum is a stratum; labels that repeat count once, as good
if all of the document's labels are; a null doc_id is judged but never labelled; rows that repeat are judged alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from strataframe.llm.shared import Scratch
from strataframe.llm.special import binomial_tail, bound

SPACES = "\\x20\\x09-\\x0D"
BLANKS = " \t\n\x0b\f\r"
#: Multiples of the spread that are candidates, loosest first.
MULTIPLES = (64.0, 32.0, 16.0, 12.0, 8.0, 6.0, 5.0, 4.0, 3.5, 3.0, 2.5, 2.0, 1.75, 1.5, 1.25, 1.0, 0.9, 0.8)
MIDDLE, HIGH = 0.5, 0.99
#: One in so many good labels proposes, the others are the holdout.
FOLDS = 5
LIMIT, LEVEL = 0.02, 0.05

#: Rules of the registered query by name, from the base counts.
RULES = {
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "long_words": "word_chars / greatest(n_words, 1)",
}


def repeat_words(words: Column, width: int = 5) -> Column:
    """Words inside runs of ``width`` words that occur twice or more in the array."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def grams(h: Column) -> Column:
        return F.transform(F.slice(h, 1, F.size(h) - (width - 1)), lambda _, i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))

    def covered(g: Column) -> Column:
        # Hashes sorted with their places; those equal to a neighbour repeat.
        placed = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            repeated = F.filter(s, lambda x, i: F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
                                | ((i > 0) & F.coalesce(F.get(s, F.greatest(i - 1, F.lit(0)))["h"] == x["h"], F.lit(False))))
            return F.array_sort(F.transform(repeated, lambda x: x["i"]))

        def count(p: Column) -> Column:
            last = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("at"))
            return F.aggregate(p, last, lambda acc, i: F.struct(
                (acc["n"] + F.least(F.lit(width), i - acc["at"])).alias("n"), i.alias("at")), lambda acc: acc["n"])

        return bound(bound(placed, places), count)

    counted = bound(bound(hashed, grams), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))
    return F.when(F.size(words) < width, F.lit(0)).otherwise(counted)


def base_counts(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    whole = F.coalesce(text, F.lit(""))
    trimmed = F.btrim(whole, F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACES}]+"))
    lines = F.filter(F.split(whole, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    return bound(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        bound(lines, lambda v: F.size(v) - F.size(F.array_distinct(v))).cast("long").alias("n_dup_lines"),
        repeat_words(w).cast("long").alias("n_repeat_words"),
    ))


def cutoffs(good: DataFrame, rules: list[str], *, limit: float = LIMIT, level: float = LEVEL) -> DataFrame:
    """``stratum``, ``rule``, ``cutoff``, ``rejected``, ``holdout``: the strictest cutoffs that keep the guarantee.

    ``good``: ``stratum``, ``holdout`` (boolean) and one column per rule, a row per good labelled document. Documents
    above a cutoff are rejected; ``rejected`` counts the holdout's by all rules of the stratum together.
    """
    long = good.where("not holdout").select("stratum", F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.col(r).cast("double").alias("value")) for r in rules])).alias("r")).select("stratum", "r.*")
    quantiles = F.percentile_approx("value", F.array(F.lit(MIDDLE), F.lit(HIGH)), F.lit(100_000)).alias("q")
    wide = lambda q: q[1] - q[0]
    every = long.groupBy("rule").agg(quantiles).select("rule", wide(F.col("q")).alias("least"))
    scales = (
        long.groupBy("stratum", "rule").agg(quantiles).join(every, "rule")
        .groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct(
            "rule", F.struct(F.col("q")[0].alias("middle"), F.greatest(wide(F.col("q")), "least").alias("spread"))))).alias("scales"))
    )
    cut = lambda r, m: F.col("scales")[r]["middle"] + m * F.col("scales")[r]["spread"]
    over = lambda m: reduce(lambda a, b: a | b, [F.col(r).cast("double") > cut(r, m) for r in rules])
    counted = good.where("holdout").alias("v").join(scales.alias("s"), F.col("v.stratum").eqNullSafe(F.col("s.stratum"))).groupBy(
        "v.stratum", "scales").agg(F.count("*").alias("holdout"), *[F.count_if(over(m)).alias(f"over{i}") for i, m in enumerate(MULTIPLES)])
    # A holdout that could not pass with nothing rejected takes no share of the level.
    counted = counted.where(F.pow(F.lit(1.0 - limit), F.col("holdout")) <= level)
    # One scalar: how many sequences of tests there are.
    sequences = counted.agg(F.count("*")).scalar()
    each = counted.select("stratum", "scales", "holdout", F.explode(F.array(*[
        F.struct(F.lit(m).alias("multiple"), F.col(f"over{i}").alias("rejected")) for i, m in enumerate(MULTIPLES)])).alias("t")).select(
        "stratum", "scales", "holdout", "t.*")
    chance = F.when(F.col("rejected") >= F.col("holdout"), F.lit(1.0)).otherwise(binomial_tail(F.col("rejected"), F.col("holdout"), limit))
    tested = each.withColumn("passed", chance * sequences <= level)
    one = tested.groupBy("stratum", "scales", "holdout").agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("multiple")).alias("order"), "multiple", "passed", "rejected"))).alias("tests"))
    # Loosest first, up to the first failure.
    upto = F.aggregate("tests", F.struct(F.lit(True).alias("open"), F.lit(None).cast("double").alias("multiple"), F.lit(None).cast("long").alias("rejected")),
                       lambda acc, t: F.when(acc["open"] & t["passed"], F.struct(F.lit(True).alias("open"), t["multiple"].alias("multiple"), t["rejected"].alias("rejected")))
                       .otherwise(F.struct(F.lit(False).alias("open"), acc["multiple"].alias("multiple"), acc["rejected"].alias("rejected"))))
    best = one.withColumn("best", upto).where("best.multiple is not null")
    return best.select("stratum", "best.multiple", "best.rejected", "holdout", F.explode("scales").alias("rule", "s")).select(
        "stratum", "rule", (F.col("s.middle") + F.col("multiple") * F.col("s.spread")).alias("cutoff"), "rejected", "holdout")


def judge(docs: DataFrame, labels: DataFrame, scratch: Scratch, *, stratum: str = "lang", limit: float = LIMIT, level: float = LEVEL) -> DataFrame:
    """One row per row of ``docs``: doc_id, the base counts, ``base_failed``, ``kept``, ``failed_rules``.

    ``labels``: doc_id, quality (1: good). A document is kept if it passes the base rules and no rule's value is over its stratum's cutoff.
    """
    rows = docs.select("doc_id", F.col(stratum).alias("stratum"), base_counts(F.col("text")).alias("b")).select("doc_id", "stratum", "b.*")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = scratch.write(rows.withColumn("base_failed", failed), "counts")
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    measured = rows.where("not base_failed").join(known, "doc_id").select(
        "stratum", (F.pmod(F.xxhash64(F.lit("holdout"), F.col("doc_id")), F.lit(FOLDS)) > 0).alias("holdout"), *[F.expr(v).alias(r) for r, v in RULES.items()])
    found = cutoffs(measured, list(RULES), limit=limit, level=level)
    found = scratch.write(found, "cutoffs")
    per = found.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int"))
    per = per.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    joined = salted.alias("d").join(per.alias("c"), F.col("d.stratum").eqNullSafe(F.col("c.stratum")) & (F.col("d.salt") == F.col("c.salt")), "left")
    over = F.filter(F.array(*[F.when(F.expr(v) > F.col("cuts")[r], F.lit(r)) for r, v in RULES.items()]), lambda r: r.isNotNull())
    return joined.withColumn("failed_rules", F.coalesce(over, F.array().cast("array<string>"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"), "failed_rules")
