"""First- and last-appearance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataframe.operators.joins import expand_levels
from strataframe.plans import appearances as app
from strataframe.workload import inputs as src, query
from strataframe.workload.common import rounded
from strataframe.workload.inputs import INTERVALS, with_
from strataframe.workload.occurrences import _resolved

FROM_OCCURRENCES_SQL = f"""{src.NAMES_SQL},
{src.KEYS_SQL},
looked AS (
  SELECT o.accepted_name_clean AS taxon, es.mid AS early_age, ls.mid AS late_age, es.stg AS early_stg, ls.stg AS late_stg
  FROM occurrences o
  LEFT JOIN interval_keys ek ON o.early_interval = ek.interval_name LEFT JOIN stages es ON ek.bin = es.stg
  LEFT JOIN interval_keys lk ON coalesce(o.late_interval, o.early_interval) = lk.interval_name
  LEFT JOIN stages ls ON lk.bin = ls.stg
  WHERE o.accepted_name_clean IN (SELECT taxon_clean FROM resolved)),
from_occ AS (
  SELECT taxon, max(early_age) AS fad_pbdb, min(late_age) AS lad_pbdb, min(early_stg) AS fad_stg, max(late_stg) AS lad_stg
  FROM looked GROUP BY 1),
own AS (
  SELECT r.taxon_clean AS taxon, t.age_late_epoch AS lad, t.age_early_epoch AS fad, t.early_epoch, t.late_epoch
  FROM traits t FULL JOIN resolved r ON t.taxa = r.taxon),
age_diff AS (
  SELECT coalesce(f.taxon, o.taxon) AS taxon, lad_pbdb - lad AS "LAD", fad_pbdb - fad AS "FAD"
  FROM from_occ f FULL JOIN (SELECT * FROM own WHERE lad IS NOT NULL AND fad IS NOT NULL) o
    ON f.taxon IS NOT DISTINCT FROM o.taxon),
epochs_compared AS (
  SELECT coalesce(f.taxon, o.taxon) AS taxon, a.series AS early_epoch_pbdb, b.series AS late_epoch_pbdb,
         o.early_epoch, o.late_epoch
  FROM from_occ f JOIN stages a ON f.fad_stg = a.stg JOIN stages b ON f.lad_stg = b.stg
  FULL JOIN own o ON f.taxon IS NOT DISTINCT FROM o.taxon)"""


def _from_occurrences(spark, sf_dir, **options):
    return app.appearances_from_occurrences(
        src.occurrences(spark, sf_dir), _resolved(spark, sf_dir), src.keys(spark), INTERVALS, **options)


def _differences(spark, sf_dir):
    own = app.appearances_from_traits(src.traits(spark, sf_dir), _resolved(spark, sf_dir))
    return app.age_differences(_from_occurrences(spark, sf_dir), own)


def _epochs(spark, sf_dir):
    return app.epochs_compared(
        _from_occurrences(spark, sf_dir), src.traits(spark, sf_dir), _resolved(spark, sf_dir), INTERVALS)


@query("fad_lad_from_occ", with_(FROM_OCCURRENCES_SQL, "SELECT * FROM from_occ"))
def fad_lad_from_occ(spark, sf_dir):
    return _from_occurrences(spark, sf_dir)


@query("fad_lad_from_occ_published", with_(FROM_OCCURRENCES_SQL, """
SELECT taxon, max(late_age) AS fad_pbdb, min(early_age) AS lad_pbdb, min(late_stg) AS fad_stg, max(early_stg) AS lad_stg
FROM looked GROUP BY 1"""))
def fad_lad_from_occ_published(spark, sf_dir):
    return _from_occurrences(spark, sf_dir, as_published=True)


@query("fad_lad_diff", with_(FROM_OCCURRENCES_SQL, "SELECT * FROM age_diff"))
def fad_lad_diff(spark, sf_dir):
    return _differences(spark, sf_dir)


@query("fad_lad_exact", with_(FROM_OCCURRENCES_SQL, """SELECT * FROM age_diff WHERE "LAD" = 0 AND "FAD" = 0"""))
def fad_lad_exact(spark, sf_dir):
    return app.same_ages(_differences(spark, sf_dir))


@query("fad_lad_older", with_(FROM_OCCURRENCES_SQL, """SELECT * FROM age_diff WHERE "FAD" > 0"""))
def fad_lad_older(spark, sf_dir):
    return app.older_first(_differences(spark, sf_dir))


@query("fad_lad_younger", with_(FROM_OCCURRENCES_SQL, """SELECT * FROM age_diff WHERE "LAD" < 0"""))
def fad_lad_younger(spark, sf_dir):
    return app.younger_last(_differences(spark, sf_dir))


@query("fad_lad_long", with_(FROM_OCCURRENCES_SQL, """
SELECT taxon, 'LAD' AS name, "LAD" AS value FROM age_diff UNION ALL SELECT taxon, 'FAD', "FAD" FROM age_diff"""))
def fad_lad_long(spark, sf_dir):
    from strataframe.operators.reshape import unpivot

    return unpivot(_differences(spark, sf_dir), ["taxon"], ["LAD", "FAD"], "name", "value")


@query("epoch_compare", with_(FROM_OCCURRENCES_SQL, "SELECT * FROM epochs_compared"))
def epoch_compare(spark, sf_dir):
    return _epochs(spark, sf_dir)


@query("epoch_older", with_(FROM_OCCURRENCES_SQL, """
SELECT c.taxon, c.early_epoch_pbdb, c.early_epoch, a.ord AS pbdb_bin, b.ord AS bin
FROM epochs_compared c JOIN epochs a ON c.early_epoch_pbdb = a.series JOIN epochs b ON c.early_epoch = b.series
WHERE a.ord < b.ord"""))
def epoch_older(spark, sf_dir):
    return app.older_epochs(_epochs(spark, sf_dir), INTERVALS)


@query("epoch_younger", with_(FROM_OCCURRENCES_SQL, """
SELECT c.taxon, c.late_epoch_pbdb, c.late_epoch, a.ord AS pbdb_bin, b.ord AS bin
FROM epochs_compared c JOIN epochs a ON c.late_epoch_pbdb = a.series JOIN epochs b ON c.late_epoch = b.series
WHERE a.ord > b.ord"""))
def epoch_younger(spark, sf_dir):
    return app.younger_epochs(_epochs(spark, sf_dir), INTERVALS)


@query("ordinal_compare", with_(FROM_OCCURRENCES_SQL, """
SELECT a.ord AS pbdb_bin, b.ord AS bin, count(*) AS n
FROM epochs_compared c JOIN epochs a ON c.early_epoch_pbdb = a.series JOIN epochs b ON c.early_epoch = b.series
WHERE a.ord <> b.ord GROUP BY 1, 2"""))
def ordinal_compare(spark, sf_dir):
    both = app.with_epoch_order(_epochs(spark, sf_dir), "early", INTERVALS)
    return both.groupBy("pbdb_bin", "bin").agg(F.count(F.lit(1)).alias("n"))


PERIOD_SQL = f"""{src.TRAITS_SQL},
firsts AS (SELECT "group", CASE WHEN early_period IN (SELECT system FROM stages) THEN early_period END AS early_period,
           count(*) AS nr_FAD FROM traits GROUP BY 1, 2),
lasts AS (SELECT "group", CASE WHEN late_period IN (SELECT system FROM stages) THEN late_period END AS late_period,
          count(*) AS nr_LAD FROM traits GROUP BY 1, 2),
both_sides AS (
  SELECT f."group", f.early_period, nr_FAD, nr_FAD / (SELECT sum(nr_FAD) FROM firsts) * 100 AS FAD_prop, nr_LAD
  FROM firsts f JOIN lasts l ON f."group" = l."group" AND f.early_period = l.late_period),
per_period AS (SELECT *, nr_LAD / (SELECT sum(nr_LAD) FROM both_sides) * 100 AS LAD_prop FROM both_sides)"""


@query("fad_lad_period", with_(PERIOD_SQL, """
SELECT * REPLACE (round(FAD_prop, 6) AS FAD_prop, round(LAD_prop, 6) AS LAD_prop) FROM per_period"""))
def fad_lad_period(spark, sf_dir):
    return rounded(app.appearances_per_period(src.traits(spark, sf_dir), INTERVALS))


@query("fad_lad_epoch_long", with_(f"""{src.TRAITS_SQL},
firsts AS (SELECT early_epoch AS epoch, count(*) AS f FROM traits GROUP BY 1),
lasts AS (SELECT late_epoch AS epoch, count(*) AS l FROM traits GROUP BY 1),
both_sides AS (SELECT f.epoch, f / (SELECT sum(f) FROM firsts) * 100 AS FAD, l FROM firsts f JOIN lasts l ON f.epoch = l.epoch),
shares AS (SELECT epoch, FAD, l / (SELECT sum(l) FROM both_sides) * 100 AS LAD FROM both_sides)""", """
SELECT s.epoch, e.mean_mid AS mid_age, 'FAD' AS name, round(s.FAD, 6) AS value FROM shares s LEFT JOIN epochs e ON s.epoch = e.series
UNION ALL SELECT s.epoch, e.mean_mid, 'LAD', round(s.LAD, 6) FROM shares s LEFT JOIN epochs e ON s.epoch = e.series"""))
def fad_lad_epoch_long(spark, sf_dir):
    return rounded(app.appearances_per_epoch_long(src.traits(spark, sf_dir), INTERVALS))


@query("publication_table", with_(PERIOD_SQL, """
SELECT CASE WHEN row_number() OVER (PARTITION BY "group" ORDER BY early_period) = 1 THEN "group" ELSE '' END AS "Taxon",
       early_period AS "Period", nr_FAD AS "#FADs", nr_LAD AS "#LADs" FROM per_period"""))
def publication_table(spark, sf_dir):
    table = app.appearances_per_period(src.traits(spark, sf_dir), INTERVALS)
    return app.publication_table(table, INTERVALS)


@query("interval_name_lookup", with_(f"{src.OCCURRENCES_SQL}, {src.KEYS_SQL}", """
SELECT e.bin AS early_bin, l.bin AS late_bin, count(*) AS n FROM occurrences o
LEFT JOIN interval_keys e ON o.early_interval = e.interval_name
LEFT JOIN interval_keys l ON coalesce(o.late_interval, o.early_interval) = l.interval_name GROUP BY 1, 2"""))
def interval_name_lookup(spark, sf_dir):
    keys = src.keys(spark)
    pairs = src.occurrences(spark, sf_dir).select(
        "early_interval", F.coalesce("late_interval", "early_interval").alias("late_interval")
    ).groupBy("early_interval", "late_interval").agg(F.count(F.lit(1)).alias("n"))
    for side in ("early", "late"):
        renamed = keys.select(F.col("interval_name").alias(f"{side}_interval"), F.col("bin").alias(f"{side}_bin"))
        pairs = pairs.join(F.broadcast(renamed), f"{side}_interval", "left")
    return pairs.groupBy("early_bin", "late_bin").agg(F.sum("n").alias("n"))


@query("cross_distinct", with_(src.TRAITS_SQL, """
SELECT g."group", s.group_id FROM (SELECT DISTINCT "group" FROM traits) g,
  (VALUES ('baseline'), ('megafauna')) s(group_id)"""))
def cross_distinct(spark, sf_dir):
    groups = src.traits(spark, sf_dir).select("group").distinct()
    return expand_levels(groups, "group_id", ["baseline", "megafauna"])
