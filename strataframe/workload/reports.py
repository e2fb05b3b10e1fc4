"""Trait-table report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataframe.functions import categories as cat
from strataframe.operators import aggregates as agg
from strataframe.operators.quantiles import reorder_by_median
from strataframe.operators.ranking import leaders, top_k
from strataframe.operators.reshape import unpivot
from strataframe.plans import reports, traits as trait_jobs
from strataframe.workload import inputs as src, query
from strataframe.workload.common import rounded
from strataframe.workload.inputs import INTERVALS, with_

LONG_SQL = f"""{src.TRAITS_SQL},
long AS (SELECT * FROM (SELECT early_era, "group", max_size_m, age_early_epoch, age_late_epoch, vertical, habitat, guild FROM traits)
  UNPIVOT INCLUDE NULLS (eco_val FOR eco_trait IN (vertical, habitat, guild)))"""


CURATED_SELECT = with_(src.CURATED_SQL, """
SELECT taxa, taxonomic_rank, "group", clade, max_size_m, guild, vertical, habitat, early_era, late_era, early_period, late_period,
  early_epoch, late_epoch,
  CASE WHEN "group" IN ('Bony fishes', 'Jawless fishes', 'Placoderms') THEN 'Fishes' ELSE "group" END AS group_clps,
  CASE WHEN max_size_m <= 5 THEN '<5m' WHEN max_size_m <= 10 THEN '5-10m' WHEN max_size_m <= 15 THEN '10-15m'
       WHEN max_size_m <= 21 THEN '>15m' END AS size_cat,
  split_part(taxa, ' ', 1) AS genus, nullif(split_part(taxa, ' ', 2), '') AS species FROM curated""")


@query("curate_traits", CURATED_SELECT)
def curate_traits(spark, sf_dir):
    return src.curated(spark, sf_dir)


@query("unmatched_names", with_(f"{src.STAGES_SQL}, {src.CURATED_SQL}", """
SELECT DISTINCT 'late' AS side, late_epoch AS name FROM curated WHERE late_epoch NOT IN (SELECT series FROM stages)
UNION ALL SELECT DISTINCT 'early', early_epoch FROM curated WHERE early_epoch NOT IN (SELECT series FROM stages)"""))
def unmatched_names(spark, sf_dir):
    c = src.curated(spark, sf_dir)
    sides = [trait_jobs.unmatched_epochs(c, f"{s}_epoch", INTERVALS).select(F.lit(s).alias("side"), F.col(f"{s}_epoch").alias("name"))
             for s in ("late", "early")]
    return sides[0].unionByName(sides[1])


@query("correct_names", with_(f"{src.STAGES_SQL}, {src.CURATED_SQL}", """
SELECT late_epoch, early_epoch, corrected_late_epoch, corrected_early_epoch, count(*) AS n FROM (
  SELECT CASE WHEN late_epoch = 'Upper Epoch F' THEN 'Epoch F' END AS corrected_late_epoch,
         CASE WHEN early_epoch = 'Epoch B beds' THEN 'Epoch B' END AS corrected_early_epoch,
         CASE WHEN late_epoch = 'Upper Epoch F' THEN 'Epoch F' ELSE late_epoch END AS late_epoch,
         CASE WHEN early_epoch = 'Epoch B beds' THEN 'Epoch B' ELSE early_epoch END AS early_epoch FROM curated) GROUP BY ALL"""))
def correct_names(spark, sf_dir):
    fixed = trait_jobs.correct_epochs(src.curated(spark, sf_dir), src.CORRECTIONS)
    return agg.counts(fixed, ["late_epoch", "early_epoch", "corrected_late_epoch", "corrected_early_epoch"])


@query("attach_ages", with_(src.TRAITS_SQL, "SELECT taxa, late_epoch, early_epoch, age_late_epoch, age_early_epoch FROM traits"))
def attach_ages(spark, sf_dir):
    return src.traits(spark, sf_dir).select("taxa", "late_epoch", "early_epoch", "age_late_epoch", "age_early_epoch")


@query("era_group_counts", with_(src.TRAITS_SQL, 'SELECT "group", late_era, count(*) AS n FROM traits GROUP BY 1, 2'))
def era_group_counts(spark, sf_dir):
    return reports.counts_by_group_and_era(src.traits(spark, sf_dir))


@query("trait_counts_by_era", with_(LONG_SQL, """
SELECT eco_trait AS trait, early_era, coalesce(eco_val, 'Missing') AS value, "group", count(*) AS n FROM long GROUP BY ALL"""))
def trait_counts_by_era(spark, sf_dir):
    return reports.trait_counts_by_era(src.traits(spark, sf_dir))


@query("unpivot_traits", with_(LONG_SQL, """
SELECT eco_trait, eco_val, round((age_early_epoch - age_late_epoch) / 2 + age_late_epoch, 6) AS age_mid,
  round(ln(max_size_m), 6) AS log_size, "group" FROM long WHERE eco_val IS NOT NULL"""))
def unpivot_traits(spark, sf_dir):
    return rounded(reports.trait_points(src.traits(spark, sf_dir)))


@query("unpivot_keeps_nulls", with_(LONG_SQL, "SELECT eco_trait, eco_val, count(*) AS n FROM long GROUP BY 1, 2"))
def unpivot_keeps_nulls(spark, sf_dir):
    long = unpivot(src.traits(spark, sf_dir), ["taxa"], ["vertical", "habitat", "guild"], "eco_trait", "eco_val")
    return agg.counts(long, ["eco_trait", "eco_val"])


@query("trait_share", with_(LONG_SQL, """
SELECT eco_trait, eco_val, "group", count(*) AS n,
  round(count(*) / sum(count(*)) OVER (PARTITION BY eco_trait) * 100, 6) AS n_perc
FROM long WHERE eco_val IS NOT NULL GROUP BY 1, 2, 3"""))
def trait_share(spark, sf_dir):
    return rounded(reports.trait_shares(src.traits(spark, sf_dir)))


@query("trait_combos", with_(src.TRAITS_SQL, """
SELECT early_era, coalesce(vertical, 'Missing') AS vertical, coalesce(habitat, 'Missing') AS habitat,
  coalesce(guild, 'Missing') AS guild, count(*) AS n FROM traits GROUP BY ALL"""))
def trait_combos(spark, sf_dir):
    return reports.trait_combinations(src.traits(spark, sf_dir))


@query("null_to_missing", with_(src.TRAITS_SQL, """
SELECT coalesce(guild, 'Missing') AS guild,
  CAST(CASE coalesce(guild, 'Missing') WHEN 'Herbivore' THEN 1 WHEN 'Micropredator' THEN 2 WHEN 'Macropredator' THEN 3 ELSE 4 END AS BIGINT) AS ord,
  count(*) AS n FROM traits GROUP BY 1, 2"""))
def null_to_missing(spark, sf_dir):
    label = cat.null_to_label(F.col("guild"))
    order = cat.level_position(label, cat.with_missing_last(cat.GUILDS))
    return src.traits(spark, sf_dir).groupBy(label.alias("guild"), order.alias("ord")).agg(F.count(F.lit(1)).alias("n"))


@query("level_order", with_(src.TRAITS_SQL, """
SELECT late_period, CAST(CASE late_period WHEN 'Period P' THEN 1 WHEN 'Period Q' THEN 2 WHEN 'Period R' THEN 3 END AS BIGINT) AS ord,
  CASE WHEN late_period <> 'Recent' THEN late_period END AS declared, count(*) AS n FROM traits GROUP BY 1, 2, 3"""))
def level_order(spark, sf_dir):
    c = F.col("late_period")
    return src.traits(spark, sf_dir).groupBy(
        c, cat.level_position(c, INTERVALS.systems).alias("ord"), cat.restrict_levels(c, INTERVALS.systems).alias("declared")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("recode_collapse", """
SELECT p_type, CASE p_type WHEN 'PROMO' THEN 'promotion' WHEN 'ECONOMY' THEN 'economy' ELSE p_type END AS recoded,
  CASE WHEN p_type IN ('SMALL', 'MEDIUM', 'LARGE') THEN 'Sized' ELSE p_type END AS collapsed, count(*) AS n FROM part GROUP BY 1, 2, 3""")
def recode_collapse(spark, sf_dir):
    t = F.col("p_type")
    return src.table(spark, sf_dir, "part").groupBy(
        t, cat.recode(t, {"PROMO": "promotion", "ECONOMY": "economy"}).alias("recoded"),
        cat.collapse(t, "Sized", ("SMALL", "MEDIUM", "LARGE")).alias("collapsed")).agg(F.count(F.lit(1)).alias("n"))


@query("reorder_by_median", with_(f"""medians AS (
SELECT o_orderpriority || '/' || o_orderstatus AS label, quantile_cont(ln(o_totalprice), 0.5) AS median FROM orders GROUP BY 1)""", """
SELECT label, round(median, 6) AS median, CAST(row_number() OVER (ORDER BY median, label) AS BIGINT) AS ord FROM medians"""))
def reorder_by_median_query(spark, sf_dir):
    orders = src.table(spark, sf_dir, "orders").select(
        F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("label"), F.log("o_totalprice").alias("x"))
    return rounded(reorder_by_median(orders, "label", "x"))


@query("null_share_total", with_(src.TRAITS_SQL, 'SELECT "group", ' + ", ".join(
    f"round(count(*) FILTER ({c} IS NULL) / (SELECT count(*) FROM traits) * 100, 6) AS {c}"
    for c in ("guild", "vertical", "habitat")) + " FROM traits GROUP BY 1"))
def null_share_total(spark, sf_dir):
    return rounded(reports.missing_report(src.traits(spark, sf_dir)))


@query("null_share_subset", with_(src.TRAITS_SQL, "SELECT " + ", ".join(
    f"round(count(*) FILTER ({c} IS NULL) / count(*) * 100, 6) AS {c}"
    for c in ("guild", "vertical", "habitat")) + """ FROM traits WHERE "group" = 'Birds'"""))
def null_share_subset(spark, sf_dir):
    return rounded(reports.missing_report_of_group(src.traits(spark, sf_dir), "Birds"))


@query("any_null_flag", with_(src.TRAITS_SQL, """
SELECT CAST(guild IS NULL OR vertical IS NULL OR habitat IS NULL AS INTEGER) AS missing, count(*) AS n FROM traits GROUP BY 1"""))
def any_null_flag(spark, sf_dir):
    return agg.counts(trait_jobs.missing_flag(src.traits(spark, sf_dir)), ["missing"])


@query("strict_min_max", """
SELECT p_brand, CASE WHEN count(x) = count(*) THEN max(x) END AS strict_max, CASE WHEN count(x) = count(*) THEN min(x) END AS strict_min,
  round(CASE WHEN count(x) = count(*) THEN avg(x) END, 6) AS strict_avg, CAST(CASE WHEN count(x) = count(*) THEN sum(x) END AS BIGINT) AS strict_sum,
  max(x) AS loose_max
FROM (SELECT p_brand, CASE WHEN p_size < 50 OR p_type <> 'PROMO' THEN CAST(p_size AS BIGINT) END AS x FROM part) GROUP BY 1""")
def strict_min_max(spark, sf_dir):
    x = F.when((F.col("p_size") < 50) | (F.col("p_type") != "PROMO"), F.col("p_size").cast("long"))
    p = src.table(spark, sf_dir, "part").select("p_brand", x.alias("x"))
    c = F.col("x")
    return rounded(p.groupBy("p_brand").agg(
        agg.strict_max(c).alias("strict_max"), agg.strict_min(c).alias("strict_min"), agg.strict_avg(c).alias("strict_avg"),
        agg.strict_sum(c).alias("strict_sum"), F.max(c).alias("loose_max")))


def _composition_sql(keys):
    return with_(src.TRAITS_SQL, " UNION ALL ".join(
        f"""SELECT '{k}' AS key, "{k}" AS label, count(*) AS n, round(count(*) / (SELECT count(*) FROM traits) * 100, 6) AS prop
FROM traits GROUP BY 2""" for k in keys))


COMPOSITION_KEYS = ("group", "taxonomic_rank", "early_era", "early_period")


@query("composition_share", _composition_sql(COMPOSITION_KEYS))
def composition_share(spark, sf_dir):
    return rounded(reports.composition(src.traits(spark, sf_dir), COMPOSITION_KEYS))


@query("clade_summary", with_(f"""{src.TRAITS_SQL},
per_clade AS (SELECT clade, max(max_size_m) AS max_size, count(*) AS n FROM traits GROUP BY 1)""", """
SELECT p.clade, p.max_size, p.n, g."group", e.late_era FROM per_clade p
JOIN (SELECT DISTINCT clade, "group" FROM traits) g ON g.clade = p.clade
JOIN (SELECT DISTINCT t.clade, t.late_era FROM traits t JOIN per_clade q ON t.clade = q.clade AND t.max_size_m = q.max_size) e ON e.clade = p.clade"""))
def clade_summary(spark, sf_dir):
    return reports.clade_summary(src.traits(spark, sf_dir))


@query("clade_era_complete", with_(f"""{src.TRAITS_SQL},
sizes AS (SELECT clade, early_era, max(max_size_m) AS max_size FROM traits GROUP BY 1, 2)""", """
SELECT c.clade, e.era AS early_era, coalesce(s.max_size, 0) AS max_size, g."group"
FROM (SELECT DISTINCT clade FROM sizes) c CROSS JOIN (VALUES ('Paleozoic'), ('Mesozoic'), ('Cenozoic')) e(era)
LEFT JOIN sizes s ON s.clade = c.clade AND s.early_era = e.era
JOIN (SELECT DISTINCT clade, "group" FROM traits) g ON g.clade = c.clade"""))
def clade_era_complete(spark, sf_dir):
    return reports.clade_sizes_by_era(src.traits(spark, sf_dir))


@query("leader_with_ties", """
SELECT p_partkey, p_brand, p_size FROM part p WHERE p_size = (SELECT max(p_size) FROM part q WHERE q.p_brand = p.p_brand)""")
def leader_with_ties(spark, sf_dir):
    p = src.table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    return leaders(p, ["p_brand"], "p_size")


@query("topk_ranges", with_(f"""{src.TRAITS_SQL},
longest AS (SELECT t."group" FROM traits t LEFT JOIN epochs e ON t.early_epoch = e.series LEFT JOIN epochs l ON t.late_epoch = l.series
  ORDER BY e.mean_mid - l.mean_mid DESC NULLS LAST, t.taxa LIMIT 17)""", 'SELECT "group", count(*) AS n FROM longest GROUP BY 1'))
def topk_ranges(spark, sf_dir):
    return reports.groups_of_longest_lived(src.traits(spark, sf_dir), INTERVALS, 17)


@query("topk_customers", """
SELECT o_custkey, max(o_orderdate) - min(o_orderdate) IS NOT NULL AS ranged, datediff('day', min(o_orderdate), max(o_orderdate)) AS days
FROM orders GROUP BY 1 ORDER BY 3 DESC NULLS LAST, 1 LIMIT 17""")
def topk_customers(spark, sf_dir):
    spans = src.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.lit(True).alias("ranged"), F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).cast("long").alias("days"))
    return top_k(spans, 17, "days", ["o_custkey"])
