"""The supplied tables seen as traits, occurrences, intervals and draws.

Each view exists twice: built with the DataFrame API for the queries, and as SQL
common table expressions for the oracle. Both read whole tables.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from strataframe.plans.occurrences import clean_occurrences, synonym_table
from strataframe.plans.traits import attach_ages, correct_epochs, curate_traits
from strataframe.sources.dimensions import Intervals, interval_keys

# Intervals over shipping ages in days: (stage, series, system, bottom, top).
_BOTTOMS = (2700, 2400, 2150, 1900, 1600, 1350, 1100, 850, 620, 400, 200, 80)
_ROWS = tuple(
    (i + 1, f"Epoch {'ABCDEF'[i // 2]}", f"Period {'PQR'[i // 4]}", float(b), float(t), (b + t) / 2, float(b - t))
    for i, (b, t) in enumerate(zip(_BOTTOMS, (*_BOTTOMS[1:], 0)))
)
INTERVALS = Intervals.from_rows(_ROWS)
#: The stages that the supplied tables have sightings in, for the columns of the oracle's matrix.
OBSERVED_BINS = tuple(range(2, 12))
INTERVAL_NAMES = {f"Stage {c}": i + 1 for i, c in enumerate("abcdefghijkl")}
ERA_BREAKS, ERA_LABELS = (2700.0, 1600.0, 620.0, 0.0), ("Cenozoic", "Mesozoic", "Paleozoic")
CORRECTIONS = {"late_epoch": {"Upper Epoch F": "Epoch F"}, "early_epoch": {"Epoch B beds": "Epoch B"}}
REASONS = ("subjective synonym of", "recombined as")
TODAY = "2002-01-01"
DIGITS, LETTERS = "0123456789", "bdghijklmo"


SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table, read with its declared schema."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _pick(index: str, *labels: str | None) -> str:
    return f"get(array({', '.join('null' if x is None else repr(x) for x in labels)}), {index})"


# Digits become letters, so that name cleaning leaves the names apart.
def _coded(number: str) -> str:
    return f"translate(cast({number} as string), '{DIGITS}', '{LETTERS}')"


def _genus(key: str) -> str:
    return f"concat('G', {_coded(f'{key} div 10')})"


def _species(key: str) -> str:
    return f"concat('t', {_coded(key)})"


_AGE = f"cast(datediff(date'{TODAY}', cast(l_shipdate as date)) as double)"
_ERAS = ("Paleozoic", "Mesozoic", "Cenozoic")
_PERIODS = ("Period P", "Period Q", "Period R")


def raw_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trait spreadsheet from ``part``: mixed-case headers, sizes as a list of texts."""
    ranged = table(spark, sf_dir, "part").selectExpr(
        "*", "cast(round(p_retailprice * 10) as int) as r", "p_partkey as k", "cast(p_size / 2 as string) as size"
    ).selectExpr(
        "*", "r % 6 as e", "least(r % 6 + p_size % 3, 5) as l",
        f"concat(if(p_brand = 'Brand#7', 'Old', ''), {_genus('k')}) as g", f"{_species('k')} as s",
    )
    groups = ("Invertebrates", "Bony_fishes", "Jawless_fishes", "Placoderms", "Birds", "Mammals")
    return ranged.selectExpr(
        "if(p_size > 8, concat(g, ' ', s), concat(g, s, ' sp.')) as Taxa",
        "if(p_size > 8, 'species', 'genus') as Taxonomic_rank",
        f"if(p_size = 50, 'Mammals', {_pick('cast((k div 10) % 6 as int)', *groups)}) as Group",
        "p_brand as Clade",
        """case when p_type = 'PROMO' then array(size, 'unknown')
                when p_type = 'MEDIUM' and p_size = 40 then cast(array() as array<string>)
                else array(size) end as Max_size_m""",
        f"{_pick('r % 4', 'Herbivore', 'Micropredator', 'Macropredator', None)} as Guild",
        f"{_pick('cast(r div 4 as int) % 4', 'Benthic', 'Benthopelagic', 'Pelagic', None)} as Vertical",
        f"{_pick('cast(r div 16 as int) % 4', 'Coastal', 'Coastal/Oceanic', 'Oceanic', None)} as Habitat",
        f"{_pick('cast(e div 2 as int)', *_ERAS)} as Early_era",
        f"{_pick('cast(l div 2 as int)', *_ERAS)} as Late_era",
        f"{_pick('cast(e div 2 as int)', *_PERIODS)} as Early_period",
        f"if(l = 5 and p_type = 'MEDIUM', 'Recent', {_pick('cast(l div 2 as int)', *_PERIODS)}) as Late_period",
        f"if(e = 1 and p_type = 'PROMO', 'Epoch B beds', concat('Epoch ', {_pick('e', *'ABCDEF')})) as Early_epoch",
        f"""case when l = 5 and p_type = 'SMALL' then 'Upper Epoch F'
                 when p_size = 49 and p_type = 'LARGE' then null
                 else concat('Epoch ', {_pick('l', *'ABCDEF')}) end as Late_epoch""",
    )


def curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate_traits(raw_traits(spark, sf_dir))


def traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated traits with corrected epochs and ages."""
    return attach_ages(correct_epochs(curated(spark, sf_dir), CORRECTIONS), INTERVALS)


def raw_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrence responses from ``lineitem``, with messy names and uneven ranks."""
    named = table(spark, sf_dir, "lineitem").selectExpr(
        "*", f"{_genus('l_partkey')} as g", f"{_species('l_partkey')} as s",
        "cast(l_suppkey % 12 as int) as st", f"{_AGE} as age",
    )
    return named.selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_extendedprice as decimal(20,2))) as occurrence_no",
        """case l_returnflag when 'R' then concat(g, ' ? cf. ', s) when 'A' then concat(g, ' ', s, ' (Subg 12)')
                else concat(' ', g, '  ', s) end as accepted_name""",
        """case l_returnflag when 'R' then concat('Old', g, ' n. ', s) when 'A' then concat(g, ' aff. ', s)
                else concat(g, ' ', s) end as identified_name""",
        """case l_returnflag when 'R' then 'subjective synonym of' when 'A' then 'recombined as'
                else 'misspelling of' end as difference""",
        "case when l_partkey % 25 = 0 then 'unranked clade' when l_quantity >= 10 then 'species' else 'genus' end as accepted_rank",
        "g as genus",
        f"{_pick('st', *INTERVAL_NAMES)} as early_interval",
        f"if(l_linenumber % 3 <> 0, {_pick('least(st + l_linenumber % 3, 11)', *INTERVAL_NAMES)}, null) as late_interval",
        "age + l_linenumber * 10 as max_ma",
        "age as min_ma",
        "l_extendedprice - floor(l_extendedprice / 360) * 360 - 180 as lng",
        "l_quantity * 3.5D - 89 as lat",
    )


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_occurrences(raw_occurrences(spark, sf_dir), dedupe=False)


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of every rank under their plain name, for binning by age."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        f"concat({_genus('l_partkey')}, ' ', {_species('l_partkey')}) as accepted_name",
        f"{_genus('l_partkey')} as genus",
        f"{_AGE} + l_linenumber * 10 as max_ma",
        f"{_AGE} as min_ma",
    )


def synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synonym_table(occurrences(spark, sf_dir), REASONS)


def keys(spark: SparkSession) -> DataFrame:
    return interval_keys(spark, INTERVAL_NAMES)


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior-like draws from ``embeddings``: 64 positions give 8 stages of 8 draws per vector.

    Even vectors are the baseline, odd ones the megafauna; a pair shares its draw ids.
    """
    e = table(spark, sf_dir, "embeddings")
    long = e.select("vec_id", "label", F.posexplode("embedding").alias("pos", "v"))
    pair = F.floor(F.col("vec_id") / 2)
    return long.select(
        F.concat(F.lit("Group "), F.col("label").cast("string")).alias("group"),
        F.when(F.col("vec_id") % 2 == 0, "baseline").otherwise("megafauna").alias("group_id"),
        (F.floor(F.col("pos") / 8) + 1).cast("int").alias("bin_occ"),
        (pair * 8 + F.col("pos") % 8).cast("long").alias("draw"),
        F.col("v").cast("double").alias("linpred"),
    )


# --- the same views as SQL -------------------------------------------------

def _case(index: str, *labels: str | None) -> str:
    arms = " ".join(
        f"WHEN {i} THEN " + ("NULL" if x is None else f"'{x}'") for i, x in enumerate(labels)
    )
    return f"CASE {index} {arms} END"


def _coded_sql(expr: str) -> str:
    return f"translate(CAST({expr} AS VARCHAR), '{DIGITS}', '{LETTERS}')"


def _genus_sql(k: str) -> str:
    return f"('G' || {_coded_sql(f'{k} // 10')})"


def _species_sql(k: str) -> str:
    return f"('t' || {_coded_sql(k)})"


# The qualifier pattern as the oracle's regular expression.
QUALIFIER_SQL = (
    r"\?|sp\.|cf\.|n\.|aff|gen\.|informal|J sensu Ristedt|A sensu Ristedt|B sensu Ristedt"
    r"|K sensu Ristedt|H sensu Ristedt|ex gr\.|\.| sp\.|spp\.|" + '"' + r"|\p{Nd}| [\t\n\f\r\p{Z}]*\([^\)]+\)"
)


def clean_sql(expr: str) -> str:
    stripped = f"regexp_replace({expr}, '{QUALIFIER_SQL}', '', 'g')"
    return f"trim(regexp_replace({stripped}, '[\\t\\n\\f\\r\\p{{Z}}]+', ' ', 'g'))"


STAGES_SQL = "stages(stg, series, system, bottom, top, mid, dur) AS (VALUES " + ", ".join(
    f"({s}, '{e}', '{p}', {b}::DOUBLE, {t}::DOUBLE, {m}::DOUBLE, {d}::DOUBLE)" for s, e, p, b, t, m, d in _ROWS
) + ")"

EPOCHS_SQL = """epochs AS (
  SELECT series, min(top) AS top, max(bottom) AS bottom, avg(mid) AS mean_mid,
         min(stg) AS first_stg, max(stg) AS last_stg,
         CAST(row_number() OVER (ORDER BY min(stg)) AS INTEGER) AS ord
  FROM stages GROUP BY series)"""

KEYS_SQL = "interval_keys(interval_name, bin) AS (VALUES " + ", ".join(
    f"('{n}', {b})" for n, b in INTERVAL_NAMES.items()
) + ")"

CURATED_SQL = f"""part_keyed AS (
  SELECT *, CAST(round(p_retailprice * 10) AS INTEGER) AS r FROM part),
part_ranged AS (
  SELECT *, r % 6 AS e, least(r % 6 + p_size % 3, 5) AS l,
         CASE WHEN p_brand = 'Brand#7' THEN 'Old' ELSE '' END || {_genus_sql('p_partkey')} AS g,
         {_species_sql('p_partkey')} AS s
  FROM part_keyed),
curated AS (
  SELECT CASE WHEN p_size > 8 THEN g || ' ' || s ELSE g || s || ' sp.' END AS taxa,
         CASE WHEN p_size > 8 THEN 'species' ELSE 'genus' END AS taxonomic_rank,
         CASE WHEN p_size = 50 THEN 'Mammals' ELSE {_case('(p_partkey // 10) % 6',
             'Invertebrates', 'Bony fishes', 'Jawless fishes', 'Placoderms', 'Birds', 'Mammals')} END AS "group",
         p_brand AS clade,
         p_size / 2.0::DOUBLE AS max_size_m,
         {_case('r % 4', 'Herbivore', 'Micropredator', 'Macropredator', None)} AS guild,
         {_case('(r // 4) % 4', 'Benthic', 'Benthopelagic', 'Pelagic', None)} AS vertical,
         {_case('(r // 16) % 4', 'Coastal', 'Coastal/Oceanic', 'Oceanic', None)} AS habitat,
         {_case('e // 2', 'Paleozoic', 'Mesozoic', 'Cenozoic')} AS early_era,
         {_case('l // 2', 'Paleozoic', 'Mesozoic', 'Cenozoic')} AS late_era,
         {_case('e // 2', 'Period P', 'Period Q', 'Period R')} AS early_period,
         CASE WHEN l = 5 AND p_type = 'MEDIUM' THEN 'Recent'
              ELSE {_case('l // 2', 'Period P', 'Period Q', 'Period R')} END AS late_period,
         CASE WHEN e = 1 AND p_type = 'PROMO' THEN 'Epoch B beds'
              ELSE 'Epoch ' || {_case('e', *'ABCDEF')} END AS early_epoch,
         CASE WHEN l = 5 AND p_type = 'SMALL' THEN 'Upper Epoch F'
              WHEN p_size = 49 AND p_type = 'LARGE' THEN NULL
              ELSE 'Epoch ' || {_case('l', *'ABCDEF')} END AS late_epoch
  FROM part_ranged
  WHERE p_size / 2.0 >= 1 AND NOT (p_type = 'MEDIUM' AND p_size = 40))"""

TRAITS_SQL = f"""{STAGES_SQL},
{EPOCHS_SQL},
{CURATED_SQL},
corrected AS (
  SELECT * REPLACE (
    CASE WHEN late_epoch = 'Upper Epoch F' THEN 'Epoch F' ELSE late_epoch END AS late_epoch,
    CASE WHEN early_epoch = 'Epoch B beds' THEN 'Epoch B' ELSE early_epoch END AS early_epoch)
  FROM curated),
traits AS (
  SELECT c.*, CASE WHEN strpos(taxa, ' ') > 0 THEN split_part(taxa, ' ', 1) ELSE taxa END AS genus,
         lt.top AS age_late_epoch, et.bottom AS age_early_epoch
  FROM corrected c LEFT JOIN epochs lt ON c.late_epoch = lt.series
                   LEFT JOIN epochs et ON c.early_epoch = et.series)"""

_MIN_MA = f"CAST(datediff('day', CAST(l_shipdate AS DATE), DATE '{TODAY}') AS DOUBLE)"

RAW_OCCURRENCES_SQL = f"""raw_occurrences AS (
  SELECT CASE l_returnflag WHEN 'R' THEN g || ' ? cf. ' || s
                           WHEN 'A' THEN g || ' ' || s || ' (Subg 12)'
                           ELSE ' ' || g || '  ' || s END AS accepted_name,
         CASE l_returnflag WHEN 'R' THEN 'Old' || g || ' n. ' || s
                           WHEN 'A' THEN g || ' aff. ' || s ELSE g || ' ' || s END AS identified_name,
         CASE l_returnflag WHEN 'R' THEN 'subjective synonym of' WHEN 'A' THEN 'recombined as'
                           ELSE 'misspelling of' END AS difference,
         CASE WHEN l_partkey % 25 = 0 THEN 'unranked clade' WHEN l_quantity >= 10 THEN 'species'
              ELSE 'genus' END AS accepted_rank,
         g AS genus,
         {_case('st', *INTERVAL_NAMES)} AS early_interval,
         CASE WHEN l_linenumber % 3 <> 0 THEN {_case('least(st + l_linenumber % 3, 11)', *INTERVAL_NAMES)} END AS late_interval,
         m + l_linenumber * 10 AS max_ma, m AS min_ma,
         l_extendedprice - floor(l_extendedprice / 360) * 360 - 180 AS lng,
         l_quantity * 3.5::DOUBLE - 89 AS lat
  FROM (SELECT *, {_genus_sql('l_partkey')} AS g, {_species_sql('l_partkey')} AS s,
               l_suppkey % 12 AS st, {_MIN_MA} AS m FROM lineitem))"""

OCCURRENCES_SQL = f"""{RAW_OCCURRENCES_SQL},
occurrences AS (
  SELECT *, {clean_sql('accepted_name')} AS accepted_name_clean
  FROM raw_occurrences WHERE accepted_rank IN ('genus', 'species'))"""

SYNONYMS_SQL = f"""{OCCURRENCES_SQL},
renamed AS (
  SELECT DISTINCT accepted_name_clean, {clean_sql('identified_name')} AS identified_name_clean
  FROM occurrences WHERE difference IN ('subjective synonym of', 'recombined as')),
synonyms AS (
  SELECT * FROM renamed WHERE accepted_name_clean <> split_part(identified_name_clean, ' ', 1))"""

NAMES_SQL = f"""{SYNONYMS_SQL},
{TRAITS_SQL},
names AS (SELECT regexp_replace(taxa, ' sp\\.$', '') AS taxa FROM (SELECT DISTINCT taxa FROM traits)),
resolved AS (
  SELECT DISTINCT n.taxa AS taxon, s.identified_name_clean, s.accepted_name_clean,
         coalesce(s.accepted_name_clean, n.taxa) AS taxon_clean
  FROM names n LEFT JOIN synonyms s ON n.taxa = s.identified_name_clean)"""

PER_TAXON_SQL = f"""{NAMES_SQL},
counted AS (SELECT accepted_name_clean, count(*) AS n FROM occurrences GROUP BY ALL),
per_taxon AS (
  SELECT r.taxon_clean AS taxon, coalesce(c.n, 0) AS occurrences, r.identified_name_clean AS synonym,
         coalesce(r.identified_name_clean, r.taxon_clean) AS taxa, t."group", t.clade, t.late_era,
         ln(1 + coalesce(c.n, 0)) AS log_occ
  FROM resolved r LEFT JOIN counted c ON r.taxon_clean = c.accepted_name_clean
  LEFT JOIN traits t ON coalesce(r.identified_name_clean, r.taxon_clean) = regexp_replace(t.taxa, ' sp\\.$', ''))"""

DATED_SQL = f"""dated AS (
  SELECT {_genus_sql('l_partkey')} || ' ' || {_species_sql('l_partkey')} AS accepted_name,
         {_genus_sql('l_partkey')} AS genus,
         {_MIN_MA} + l_linenumber * 10 AS max_ma, {_MIN_MA} AS min_ma
  FROM lineitem)"""

BINNED_SQL = f"""{DATED_SQL},
{TRAITS_SQL},
bottoms AS (SELECT bottom AS hi, lag(bottom) OVER (ORDER BY bottom) AS lo,
                   row_number() OVER (ORDER BY bottom) - 1 AS idx FROM stages),
tops AS (SELECT top AS hi, lag(top) OVER (ORDER BY top) AS lo,
                row_number() OVER (ORDER BY top) - 1 AS idx FROM stages),
ages AS (
  SELECT DISTINCT accepted_name, max_ma, min_ma FROM dated),
binned AS (
  SELECT a.accepted_name, CAST(12 - b.idx AS INTEGER) AS bin_max, CAST(13 - t.idx AS INTEGER) AS bin_min
  FROM ages a
  JOIN bottoms b ON (a.max_ma > b.lo OR (b.idx = 1 AND a.max_ma = b.lo)) AND a.max_ma <= b.hi
  JOIN tops t ON (a.min_ma > t.lo OR (t.idx = 1 AND a.min_ma = t.lo)) AND a.min_ma <= t.hi),
species_names AS (SELECT DISTINCT taxa FROM traits WHERE taxonomic_rank = 'species'),
genus_groups AS (SELECT DISTINCT "group", genus FROM traits WHERE taxonomic_rank = 'species')"""

SIGHTINGS_SQL = f"""{BINNED_SQL},
sightings AS (
  SELECT DISTINCT b.accepted_name, b.bin_max AS bin,
         CASE WHEN s.taxa IS NOT NULL THEN 'megafauna' ELSE 'baseline' END AS group_id, g."group"
  FROM binned b LEFT JOIN species_names s ON b.accepted_name = s.taxa
  JOIN genus_groups g ON split_part(b.accepted_name, ' ', 1) = g.genus
  WHERE b.bin_max = b.bin_min)"""

SIGNAL_SQL = f"""{BINNED_SQL},
taxon_ranges AS (
  SELECT accepted_name, min(bin_max) AS bin_ori, max(bin_min) AS bin_ext FROM binned GROUP BY 1),
signal AS (
  SELECT r.accepted_name, CAST(x.b AS INTEGER) AS bin_occ, r.bin_ext,
         CAST(x.b = r.bin_ext AS INTEGER) AS ext_signal,
         CASE WHEN s.taxa IS NOT NULL THEN 'megafauna' ELSE 'baseline' END AS group_id, g.genus, g."group"
  FROM taxon_ranges r
  JOIN (SELECT unnest(generate_series(1, 12)) AS b) x ON x.b BETWEEN r.bin_ori AND r.bin_ext
  LEFT JOIN species_names s ON r.accepted_name = s.taxa
  JOIN genus_groups g ON split_part(r.accepted_name, ' ', 1) = g.genus)"""

DRAWS_SQL = """draws AS (
  SELECT 'Group ' || label AS "group", CASE WHEN vec_id % 2 = 0 THEN 'baseline' ELSE 'megafauna' END AS group_id,
         CAST(pos // 8 + 1 AS INTEGER) AS bin_occ, (vec_id // 2) * 8 + pos % 8 AS draw,
         CAST(embedding[pos + 1] AS DOUBLE) AS linpred
  FROM embeddings, (SELECT unnest(generate_series(0, 63)) AS pos))"""


def with_(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body.strip()}"


@lru_cache(maxsize=None)
def cut_sql(value: str, breaks: tuple[float, ...], labels: tuple[str, ...]) -> str:
    b = sorted(breaks)
    arms = " ".join(f"WHEN {value} > {lo} AND {value} <= {hi} THEN '{x}'" for lo, hi, x in zip(b, b[1:], labels))
    return f"CASE {arms} END"
