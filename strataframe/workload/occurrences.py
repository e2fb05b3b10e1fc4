"""Name cleaning, synonyms, coverage and per-taxon count queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataframe.functions import text
from strataframe.operators.joins import count_by_name, members_only, membership_flag, nullsafe_join
from strataframe.operators.density import histogram
from strataframe.plans import occurrences as occ
from strataframe.sources.landing import drop_empty_sources, drop_repeated_occurrences
from strataframe.sources.manifest import request_manifest
from strataframe.operators.reshape import stack
from strataframe.workload import inputs as src, query
from strataframe.workload.common import rounded
from strataframe.workload.inputs import clean_sql, with_


def _resolved(spark, sf_dir):
    return occ.resolve_names(occ.taxon_names(src.traits(spark, sf_dir)), src.synonyms(spark, sf_dir))


def per_taxon(spark, sf_dir):
    return occ.occurrences_per_taxon(
        _resolved(spark, sf_dir), src.occurrences(spark, sf_dir), src.traits(spark, sf_dir)
    )


@query("clean_names", f"SELECT doc_id, {clean_sql('text')} AS cleaned FROM documents")
def clean_names(spark, sf_dir):
    d = src.table(spark, sf_dir, "documents")
    return d.select("doc_id", text.clean_name(F.col("text")).alias("cleaned"))


@query("squish", r"SELECT conv_id, turn, trim(regexp_replace(text, '[\t\n\f\r\p{Z}]+', ' ', 'g')) AS squished FROM conversations")
def squish(spark, sf_dir):
    c = src.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", text.squish(F.col("text")).alias("squished"))


@query("token_count", r"""
SELECT doc_id, CAST(len(regexp_extract_all(text, '[^\t\n\f\r\p{Z}]+')) AS INTEGER) AS tokens,
       split_part(text, ' ', 1) AS first_word FROM documents""")
def token_count(spark, sf_dir):
    d = src.table(spark, sf_dir, "documents")
    return d.select("doc_id", text.token_count(F.col("text")).cast("int").alias("tokens"),
                    text.first_word(F.col("text")).alias("first_word"))


@query("first_word", "SELECT split_part(p_name, ' ', 1) AS word, count(*) AS n FROM part GROUP BY 1")
def first_word(spark, sf_dir):
    p = src.table(spark, sf_dir, "part")
    return p.groupBy(text.first_word(F.col("p_name")).alias("word")).agg(F.count(F.lit(1)).alias("n"))


@query("strip_suffix", with_(src.CURATED_SQL, r"""
SELECT taxa, regexp_replace(taxa, ' sp\.$', '') AS stripped, regexp_replace(taxa, ' sp.', '', 'g') AS as_published
FROM curated"""))
def strip_suffix(spark, sf_dir):
    taxa = F.col("taxa")
    return src.curated(spark, sf_dir).select(
        taxa, text.strip_open_suffix(taxa).alias("stripped"),
        text.strip_open_suffix(taxa, as_published=True).alias("as_published"))


@query("title_case", """
SELECT event_type, upper(event_type[1]) || lower(event_type[2:]) AS label, count(*) AS n FROM events GROUP BY 1""")
def title_case(spark, sf_dir):
    e = src.table(spark, sf_dir, "events")
    return e.groupBy("event_type", text.title_case(F.col("event_type")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("split_binomial", with_(src.CURATED_SQL, """
SELECT taxa, split_part(taxa, ' ', 1) AS genus, nullif(split_part(taxa, ' ', 2), '') AS species FROM curated"""))
def split_binomial(spark, sf_dir):
    return src.curated(spark, sf_dir).select("taxa", "genus", "species")


@query("request_manifest", with_(src.NAMES_SQL, """
SELECT DISTINCT taxa AS taxon, 'occs/list.tsv?base_name=' || replace(taxa, ' ', '%20')
  || '&extant=no&show=classext,ident,coords' AS request_key FROM names"""))
def request_manifest_query(spark, sf_dir):
    names = occ.taxon_names(src.traits(spark, sf_dir))
    return request_manifest(names, "taxa", endpoint="occs/list.tsv?")


def _responses(spark, sf_dir):
    """Two overlapping responses per genus, and the message row of an empty one."""
    raw = src.raw_occurrences(spark, sf_dir)
    by_genus = raw.withColumn("source_key", F.concat(F.lit("genus/"), "genus"))
    by_name = raw.where(F.col("accepted_rank").isin("genus", "species")).withColumn(
        "source_key", F.concat(F.lit("name/"), "accepted_name"))
    empty = src.table(spark, sf_dir, "supplier").select(
        F.lit("THIS REQUEST RETURNED NO RECORDS").alias("occurrence_no"),
        F.concat(F.lit("empty/"), "s_name").alias("source_key"))
    return stack(by_genus, by_name, empty), raw.columns


@query("drop_no_records", with_(src.RAW_OCCURRENCES_SQL, """
SELECT split_part(source, '/', 1) AS kind, count(*) AS n FROM (
  SELECT 'genus/' AS source FROM raw_occurrences
  UNION ALL SELECT 'name/' FROM raw_occurrences WHERE accepted_rank IN ('genus', 'species')) GROUP BY 1"""))
def drop_no_records(spark, sf_dir):
    responses, columns = _responses(spark, sf_dir)
    kept = drop_empty_sources(responses, payload=columns)
    return kept.groupBy(text.first_word(F.translate("source_key", "/", " ")).alias("kind")).agg(
        F.count(F.lit(1)).alias("n"))


@query("drop_repeated_occurrences", """
SELECT count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem)""")
def drop_repeated(spark, sf_dir):
    responses, columns = _responses(spark, sf_dir)
    kept = drop_empty_sources(responses, payload=columns)
    return drop_repeated_occurrences(kept.select("occurrence_no", "accepted_name")).agg(F.count(F.lit(1)).alias("n"))


@query("clean_occurrences", with_(src.OCCURRENCES_SQL, """
SELECT accepted_name_clean, accepted_rank, count(*) AS n FROM occurrences GROUP BY ALL"""))
def clean_occurrences(spark, sf_dir):
    return src.occurrences(spark, sf_dir).groupBy("accepted_name_clean", "accepted_rank").agg(
        F.count(F.lit(1)).alias("n"))


@query("synonym_table", with_(src.SYNONYMS_SQL, "SELECT DISTINCT accepted_name_clean, identified_name_clean FROM synonyms"))
def synonym_table(spark, sf_dir):
    return src.synonyms(spark, sf_dir)


@query("synonym_resolve", with_(src.NAMES_SQL, "SELECT * FROM resolved"))
def synonym_resolve(spark, sf_dir):
    return _resolved(spark, sf_dir)


@query("concat_name_sets", with_(src.SYNONYMS_SQL, """
SELECT name, count(*) AS n FROM (SELECT DISTINCT accepted_name_clean AS name FROM occurrences
  UNION ALL SELECT identified_name_clean FROM synonyms) GROUP BY 1"""))
def concat_name_sets(spark, sf_dir):
    known = occ.known_names(src.occurrences(spark, sf_dir), src.synonyms(spark, sf_dir))
    return known.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("coverage_levels", with_(f"""{src.NAMES_SQL},
known AS (SELECT accepted_name_clean AS name FROM occurrences UNION SELECT identified_name_clean FROM synonyms),
genera AS (SELECT DISTINCT split_part(name, ' ', 1) AS g FROM known),
tally AS (
  SELECT count(*) FILTER (split_part(taxa, ' ', 1) IN (SELECT g FROM genera)) AS m0, count(*) AS t0,
         count(*) FILTER (strpos(taxa, ' ') = 0 AND taxa IN (SELECT name FROM known)) AS m1,
         count(*) FILTER (strpos(taxa, ' ') = 0) AS t1,
         count(*) FILTER (strpos(taxa, ' ') > 0 AND taxa IN (SELECT name FROM known)) AS m2,
         count(*) FILTER (strpos(taxa, ' ') > 0) AS t2 FROM names)""", """
SELECT 'genus' AS level, m0 AS matched, t0 AS total, round(m0 / t0, 6) AS share FROM tally
UNION ALL SELECT 'genus_only', m1, t1, round(m1 / t1, 6) FROM tally
UNION ALL SELECT 'species', m2, t2, round(m2 / t2, 6) FROM tally"""))
def coverage_levels(spark, sf_dir):
    known = occ.known_names(src.occurrences(spark, sf_dir), src.synonyms(spark, sf_dir))
    return rounded(occ.coverage(occ.taxon_names(src.traits(spark, sf_dir)), known))


@query("membership_flag", with_(src.NAMES_SQL, """
SELECT taxa, CASE WHEN taxa IN (SELECT accepted_name_clean FROM occurrences) THEN 'listed' ELSE 'absent' END AS flag FROM names"""))
def membership_flag_query(spark, sf_dir):
    names = occ.taxon_names(src.traits(spark, sf_dir))
    return membership_flag(names, "taxa", src.occurrences(spark, sf_dir), "accepted_name_clean",
                           yes="listed", no="absent", out="flag")


@query("semi_join_members", """
SELECT c_mktsegment, count(*) AS n FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders) GROUP BY 1""")
def semi_join_members(spark, sf_dir):
    kept = members_only(src.table(spark, sf_dir, "customer"), "c_custkey", src.table(spark, sf_dir, "orders"), "o_custkey")
    return kept.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("nullsafe_left_join", with_("""keyed AS (SELECT nullif(p_type, 'PROMO') AS kind, p_brand, p_size FROM part),
per_kind AS (SELECT kind, max(p_size) AS largest FROM keyed GROUP BY 1)""", """
SELECT k.kind, k.p_brand, count(*) AS n, max(largest) AS largest
FROM keyed k LEFT JOIN per_kind p ON k.kind IS NOT DISTINCT FROM p.kind GROUP BY ALL"""))
def nullsafe_left_join(spark, sf_dir):
    keyed = src.table(spark, sf_dir, "part").select(
        F.nullif("p_type", F.lit("PROMO")).alias("kind"), "p_brand", "p_size")
    per_kind = keyed.groupBy("kind").agg(F.max("p_size").alias("largest"))
    return nullsafe_join(keyed, per_kind, ["kind"]).groupBy("kind", "p_brand").agg(
        F.count(F.lit(1)).alias("n"), F.max("largest").alias("largest"))


@query("full_join_coalesce", with_("""small AS (SELECT nullif(p_type, 'PROMO') AS kind, p_brand AS brand, count(*) AS n_small
  FROM part WHERE p_size <= 30 GROUP BY ALL),
large AS (SELECT nullif(p_type, 'PROMO') AS kind, p_brand AS brand, count(*) AS n_large FROM part WHERE p_size >= 20 GROUP BY ALL)""", """
SELECT coalesce(s.kind, l.kind) AS kind, coalesce(s.brand, l.brand) AS brand, n_small, n_large
FROM small s FULL JOIN large l ON s.kind IS NOT DISTINCT FROM l.kind AND s.brand IS NOT DISTINCT FROM l.brand"""))
def full_join_coalesce(spark, sf_dir):
    keyed = src.table(spark, sf_dir, "part").select(
        F.nullif("p_type", F.lit("PROMO")).alias("kind"), F.col("p_brand").alias("brand"), "p_size")
    sides = [keyed.where(cond).groupBy("kind", "brand").agg(F.count(F.lit(1)).alias(name))
             for cond, name in ((F.col("p_size") <= 30, "n_small"), (F.col("p_size") >= 20, "n_large"))]
    return nullsafe_join(*sides, ["kind", "brand"], "full")


@query("correlated_count", """
SELECT c_custkey, c_mktsegment, count(o_orderkey) AS occurrences FROM customer
LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2""")
def correlated_count(spark, sf_dir):
    orders = src.table(spark, sf_dir, "orders")
    names = src.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return count_by_name(names, "c_custkey", orders, "o_custkey")


@query("occurrences_per_taxon", with_(src.PER_TAXON_SQL, "SELECT * REPLACE (round(log_occ, 6) AS log_occ) FROM per_taxon"))
def occurrences_per_taxon(spark, sf_dir):
    return rounded(per_taxon(spark, sf_dir))


@query("overview_by_group", with_(f"""{src.PER_TAXON_SQL},
tally AS (SELECT "group", nullif(count(*) FILTER (occurrences > 0), 0) AS yes, count(*) FILTER (occurrences = 0) AS no,
  count(*) FILTER (occurrences = 1) AS single, nullif(count(*) FILTER (occurrences > 1), 0) AS many FROM per_taxon GROUP BY 1)""", """
SELECT "group", round(yes / (no + yes), 6) AS prop_has_occ, yes AS number_of_taxa_with_occ,
  CASE WHEN yes > 0 THEN single END AS number_of_singletons, round(single / (many + single), 6) AS prop_singletons FROM tally"""))
def overview_by_group(spark, sf_dir):
    return rounded(occ.overview(per_taxon(spark, sf_dir)))


@query("presence_pct", with_(f"""{src.PER_TAXON_SQL},
tally AS (SELECT "group", count(*) FILTER (occurrences = 0) AS abs, nullif(count(*) FILTER (occurrences <> 0), 0) AS pres
  FROM per_taxon GROUP BY 1)""", """
SELECT "group", abs, pres, round(pres / (abs + pres) * 100, 6) AS pres_perc FROM tally"""))
def presence_pct(spark, sf_dir):
    return rounded(occ.presence_percent(per_taxon(spark, sf_dir)))


@query("share_gt_one", with_(src.PER_TAXON_SQL, """
SELECT 'species' AS level, round(count(*) FILTER (occurrences > 1) / count(*), 6) AS share FROM per_taxon WHERE strpos(taxon, ' ') > 0
UNION ALL SELECT 'genus', round(count(*) FILTER (occurrences > 1) / count(*), 6) FROM per_taxon WHERE strpos(taxon, ' ') = 0"""))
def share_gt_one(spark, sf_dir):
    return rounded(occ.share_with_several(per_taxon(spark, sf_dir)))


@query("ranked_list", with_(src.PER_TAXON_SQL, """
SELECT taxa, "group", taxon, occurrences, CAST(row_number() OVER (ORDER BY log_occ, taxa, taxon, "group", late_era, clade) AS BIGINT) AS position
FROM (SELECT DISTINCT * FROM per_taxon WHERE occurrences >= 1)"""))
def ranked_list(spark, sf_dir):
    from strataframe.operators.ranking import global_row_number

    listed = per_taxon(spark, sf_dir).where(F.col("occurrences") >= 1).distinct()
    # The count orders like its logarithm and compares exactly.
    ranked = global_row_number(listed, ["occurrences", "taxa", "taxon", "group", "late_era", "clade"], "position")
    return ranked.select("taxa", "group", "taxon", "occurrences", "position")


@query("group_leaders", with_(src.PER_TAXON_SQL, """
SELECT DISTINCT taxa, "group", occurrences FROM per_taxon p WHERE occurrences >= 1 AND occurrences =
  (SELECT max(occurrences) FROM per_taxon q WHERE q."group" IS NOT DISTINCT FROM p."group")"""))
def group_leaders(spark, sf_dir):
    from strataframe.operators.ranking import leaders

    listed = occ.ranked_list(per_taxon(spark, sf_dir)).select("taxa", "group", "occurrences").distinct()
    return leaders(listed, ["group"], "occurrences")


@query("hist_occurrences", with_(src.PER_TAXON_SQL, """
SELECT CAST(ceil(occurrences / 1.0 - 0.5) AS BIGINT) AS bin, count(*) AS n FROM per_taxon WHERE strpos(taxon, ' ') > 0 GROUP BY 1"""))
def hist_occurrences(spark, sf_dir):
    species = per_taxon(spark, sf_dir).where(text.token_count(F.col("taxon")) == 2)
    return histogram(species, "occurrences", 1.0)


@query("hist_occurrences_log", with_(src.PER_TAXON_SQL, """
SELECT CAST(ceil(ln(1 + occurrences) / 0.1::DOUBLE - 0.5) AS BIGINT) AS bin, count(*) AS n FROM per_taxon WHERE strpos(taxon, ' ') > 0 GROUP BY 1"""))
def hist_occurrences_log(spark, sf_dir):
    species = per_taxon(spark, sf_dir).where(text.token_count(F.col("taxon")) == 2)
    return histogram(species, "log_occ", 0.1)


@query("occurrence_total", with_(src.PER_TAXON_SQL, """
SELECT "group", CAST(sum(occurrences) AS BIGINT) AS occurrences FROM per_taxon GROUP BY 1"""))
def occurrence_total(spark, sf_dir):
    return per_taxon(spark, sf_dir).groupBy("group").agg(F.sum("occurrences").alias("occurrences"))


@query("difference_reasons", with_(src.OCCURRENCES_SQL, "SELECT difference, count(*) AS n FROM occurrences GROUP BY 1"))
def difference_reasons(spark, sf_dir):
    return occ.reasons_used(src.occurrences(spark, sf_dir))
