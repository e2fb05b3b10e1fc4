"""Binning, range-through and capture-history queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataframe.functions.binning import cut_label, era_of_age, size_class
from strataframe.operators import captures
from strataframe.operators.joins import interval_join
from strataframe.plans import stages
from strataframe.workload import query
from strataframe.workload import inputs as src
from strataframe.workload.common import rounded
from strataframe.workload.inputs import INTERVALS, with_


@query("richness_by_interval", with_(src.TRAITS_SQL, """
SELECT t."group", s.stg AS stg_occ, count(*) AS n, s.mid
FROM traits t JOIN epochs e ON t.early_epoch = e.series JOIN epochs l ON t.late_epoch = l.series
JOIN stages s ON s.stg BETWEEN e.first_stg AND l.last_stg
GROUP BY ALL"""))
def richness_by_interval(spark, sf_dir):
    return stages.standing_richness(src.traits(spark, sf_dir), INTERVALS)


@query("group_range_mid", with_(src.TRAITS_SQL, """
SELECT "group", max(age_early_epoch) AS age_early_epoch,
       CASE WHEN count(age_late_epoch) = count(*) THEN min(age_late_epoch) END AS age_late_epoch,
       CASE WHEN count(age_late_epoch) = count(*) THEN
         (max(age_early_epoch) - min(age_late_epoch)) / 2 + min(age_late_epoch) END AS age_mid
FROM traits GROUP BY 1"""))
def group_range_mid(spark, sf_dir):
    return stages.group_ranges(src.traits(spark, sf_dir))


@query("size_class", """
SELECT p_partkey, p_size, CASE WHEN p_size > 0 AND p_size <= 5 THEN '<5m' WHEN p_size > 5 AND p_size <= 10 THEN '5-10m'
  WHEN p_size > 10 AND p_size <= 15 THEN '10-15m' WHEN p_size > 15 AND p_size <= 21 THEN '>15m' END AS size_cat
FROM part""")
def size_class_query(spark, sf_dir):
    part = src.table(spark, sf_dir, "part")
    return part.select("p_partkey", "p_size", size_class(F.col("p_size")).alias("size_cat"))


@query("era_bin_agree", with_(src.DATED_SQL, f"""
SELECT era_max AS era, count(*) AS n FROM (
  SELECT {src.cut_sql('max_ma', src.ERA_BREAKS, src.ERA_LABELS)} AS era_max,
         {src.cut_sql('min_ma', src.ERA_BREAKS, src.ERA_LABELS)} AS era_min FROM dated)
WHERE era_max = era_min GROUP BY 1"""))
def era_bin_agree(spark, sf_dir):
    d = src.dated(spark, sf_dir)
    older, younger = (era_of_age(F.col(c), src.ERA_BREAKS, src.ERA_LABELS) for c in ("max_ma", "min_ma"))
    return d.select(older.alias("era"), younger.alias("era_min")).where(F.col("era") == F.col("era_min")).groupBy(
        "era").agg(F.count(F.lit(1)).alias("n"))


@query("stage_bounds", with_(f"""{src.DATED_SQL}, {src.STAGES_SQL},
bottoms AS (SELECT bottom AS hi, lag(bottom) OVER (ORDER BY bottom) AS lo,
                   row_number() OVER (ORDER BY bottom) - 1 AS idx FROM stages),
tops AS (SELECT top AS hi, lag(top) OVER (ORDER BY top) AS lo,
                row_number() OVER (ORDER BY top) - 1 AS idx FROM stages)""", """
SELECT CAST(12 - b.idx AS INTEGER) AS bin_max, CAST(13 - t.idx AS INTEGER) AS bin_min, count(*) AS n
FROM dated a
JOIN bottoms b ON (a.max_ma > b.lo OR (b.idx = 1 AND a.max_ma = b.lo)) AND a.max_ma <= b.hi
JOIN tops t ON (a.min_ma > t.lo OR (t.idx = 1 AND a.min_ma = t.lo)) AND a.min_ma <= t.hi
GROUP BY 1, 2"""))
def stage_bounds(spark, sf_dir):
    binned = stages.bin_bounds(src.dated(spark, sf_dir), INTERVALS)
    return binned.groupBy("bin_max", "bin_min").agg(F.count(F.lit(1)).alias("n"))


@query("interval_join_lookup", with_(f"{src.DATED_SQL}, {src.STAGES_SQL}", """
SELECT s.stg, count(*) AS n FROM dated d
LEFT JOIN stages s ON d.min_ma > s.top AND d.min_ma <= s.bottom GROUP BY 1"""))
def interval_join_lookup(spark, sf_dir):
    looked = interval_join(src.dated(spark, sf_dir), "min_ma", INTERVALS.to_df(spark), "top", "bottom", width=60.0)
    return looked.groupBy("stg").agg(F.count(F.lit(1)).alias("n"))


@query("stage_bin_single", with_(src.SIGHTINGS_SQL, "SELECT * FROM sightings"))
def stage_bin_single(spark, sf_dir):
    return stages.single_stage_occurrences(src.dated(spark, sf_dir), src.traits(spark, sf_dir), INTERVALS)


@query("range_through_signal", with_(src.SIGNAL_SQL, "SELECT * FROM signal"))
def range_through_signal(spark, sf_dir):
    return stages.range_through(src.dated(spark, sf_dir), src.traits(spark, sf_dir), INTERVALS)


@query("presence_matrix", with_(src.SIGHTINGS_SQL, "SELECT accepted_name, group_id, " + ", ".join(
    f"max(CAST(bin = {b} AS INTEGER)) AS bin_{b}" for b in src.OBSERVED_BINS) + " FROM sightings GROUP BY 1, 2"))
def presence_matrix(spark, sf_dir):
    seen = stages.single_stage_occurrences(src.dated(spark, sf_dir), src.traits(spark, sf_dir), INTERVALS)
    return stages.presence_absence(seen, INTERVALS)


@query("interval_durations", with_(src.SIGHTINGS_SQL, """
SELECT stg, dur FROM stages WHERE stg BETWEEN (SELECT min(bin) FROM sightings) AND (SELECT max(bin) FROM sightings)"""))
def interval_durations(spark, sf_dir):
    seen = stages.single_stage_occurrences(src.dated(spark, sf_dir), src.traits(spark, sf_dir), INTERVALS)
    return INTERVALS.durations(spark, seen)


@query("capture_m_array", with_(f"""{src.SIGHTINGS_SQL},
steps AS (SELECT group_id, bin, lead(bin) OVER (PARTITION BY group_id, accepted_name ORDER BY bin) AS next_bin
          FROM (SELECT DISTINCT group_id, accepted_name, bin FROM sightings))""", """
SELECT group_id, bin, next_bin, count(*) AS n FROM steps GROUP BY ALL"""))
def capture_m_array(spark, sf_dir):
    seen = stages.single_stage_occurrences(src.dated(spark, sf_dir), src.traits(spark, sf_dir), INTERVALS)
    return captures.recapture_array(seen, "accepted_name", "bin", ["group_id"])


@query("capture_sampling_rate", with_(f"""{src.SIGHTINGS_SQL},
once AS (SELECT DISTINCT group_id, accepted_name, bin FROM sightings),
spans AS (SELECT group_id, accepted_name, min(bin) AS lo, max(bin) AS hi FROM once GROUP BY 1, 2)""", """
SELECT s.group_id, CAST(x.b AS INTEGER) AS bin, count(o.bin) AS seen, count(*) AS ranging,
       round(count(o.bin) / count(*), 6) AS rate
FROM spans s JOIN (SELECT unnest(generate_series(1, 12)) AS b) x ON x.b BETWEEN s.lo AND s.hi
LEFT JOIN once o ON o.group_id = s.group_id AND o.accepted_name = s.accepted_name AND o.bin = x.b
GROUP BY 1, 2"""))
def capture_sampling_rate(spark, sf_dir):
    seen = stages.single_stage_occurrences(src.dated(spark, sf_dir), src.traits(spark, sf_dir), INTERVALS)
    return rounded(captures.sampling_rate(seen, "accepted_name", "bin", ["group_id"]))


@query("spatial_by_era", with_(f"{src.OCCURRENCES_SQL}, {src.TRAITS_SQL}", f"""
SELECT round(o.lng, 6) AS lng, round(o.lat, 6) AS lat, o.era_min AS era, g."group" FROM (
  SELECT *, {src.cut_sql('max_ma', src.ERA_BREAKS, src.ERA_LABELS)} AS era_max,
         {src.cut_sql('min_ma', src.ERA_BREAKS, src.ERA_LABELS)} AS era_min FROM occurrences) o
JOIN (SELECT DISTINCT "group", genus FROM traits) g ON o.genus = g.genus
WHERE era_max = era_min"""))
def spatial_by_era(spark, sf_dir):
    from strataframe.plans.reports import spatial_by_era as job

    return rounded(job(src.occurrences(spark, sf_dir), src.traits(spark, sf_dir),
                       breaks=src.ERA_BREAKS, labels=src.ERA_LABELS))


@query("quantity_class", """
SELECT CASE WHEN l_quantity > 0 AND l_quantity <= 10 THEN 'low' WHEN l_quantity > 10 AND l_quantity <= 30 THEN 'mid'
  WHEN l_quantity > 30 AND l_quantity <= 45 THEN 'high' END AS class, count(*) AS n FROM lineitem GROUP BY 1""")
def quantity_class(spark, sf_dir):
    cls = cut_label(F.col("l_quantity"), (0, 10, 30, 45), ("low", "mid", "high"))
    return src.table(spark, sf_dir, "lineitem").groupBy(cls.alias("class")).agg(F.count(F.lit(1)).alias("n"))
