"""Stacking and file round-trip queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataframe.operators.reshape import stack
from strataframe.plans.traits import curate_traits
from strataframe.sources.landing import NO_RECORDS, read_delimited, read_occurrences, read_trait_parts
from strataframe.sources.tables import read_table, scratch_dir, write_csv, write_table
from strataframe.workload import inputs as src, query
from strataframe.workload.reports import CURATED_SELECT


@query("stack_parts", """
SELECT c_custkey AS key, c_name AS name, c_acctbal AS acctbal, CAST(c_nationkey AS VARCHAR) AS nation, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_suppkey, s_name, s_acctbal, CAST(s_nationkey AS VARCHAR), NULL FROM supplier""")
def stack_parts(spark, sf_dir):
    c, s = (src.table(spark, sf_dir, n) for n in ("customer", "supplier"))
    customers = c.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"),
                         F.col("c_nationkey").cast("string").alias("nation"), F.col("c_mktsegment").alias("segment"))
    suppliers = s.select(F.col("s_nationkey").cast("string").alias("nation"), F.col("s_suppkey").alias("key"),
                         F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"))
    return stack(customers, suppliers)


@query("io_roundtrip", """
SELECT f.format, c.* FROM customer c, (VALUES ('csv'), ('tsv'), ('parquet')) f(format)""")
def io_roundtrip(spark, sf_dir):
    """Write the customers as CSV, TSV and gzip Parquet into a new shared folder and read them back."""
    customer = src.table(spark, sf_dir, "customer")
    base = scratch_dir(spark)
    write_csv(customer, f"{base}/csv")
    write_csv(customer, f"{base}/tsv", sep="\t")
    write_table(customer, f"{base}/parquet", gzip=True)
    schema = customer.schema
    csv = read_delimited(spark, f"{base}/csv", schema, null_value="NA", source_key=None)
    tsv = read_delimited(spark, f"{base}/tsv", schema, sep="\t", quoting=False, null_value="NA", source_key=None)
    parquet = read_table(spark, f"{base}/parquet")
    return stack(*[df.select(F.lit(n).alias("format"), "*") for n, df in (("csv", csv), ("tsv", tsv), ("parquet", parquet))])


@query("trait_parts", CURATED_SELECT)
def trait_parts(spark, sf_dir):
    """Write the trait sheets as five CSV parts, stack them again and curate."""
    raw = src.raw_traits(spark, sf_dir)
    path = f"{scratch_dir(spark)}/sheets"
    write_csv(raw.withColumn("Max_size_m", F.array_join("Max_size_m", ";")).repartition(5), path, null_value="")
    return curate_traits(read_trait_parts(spark, path, source_key=None))


@query("occurrence_files", src.with_(src.RAW_OCCURRENCES_SQL, """
SELECT accepted_rank, starts_with(name, '"') AS quoted, count(*) AS n, count(DISTINCT name) AS names, count(late_interval) AS late,
  round(sum(max_ma), 3) AS max_ma, round(sum(lng), 3) AS lng, CAST(sum(length(accepted_name)) AS BIGINT) AS length
FROM (SELECT *, CASE WHEN accepted_rank = 'genus' THEN '"' ELSE '' END || identified_name AS name FROM raw_occurrences)
GROUP BY ALL"""))
def occurrence_files(spark, sf_dir):
    """Occurrences as unquoted responses in two column orders among empty and two-column ones, read back file by file."""
    raw = src.raw_occurrences(spark, sf_dir)
    # A single quote would swallow what follows in a reader that takes quotes for its own.
    opening = F.when(F.col("accepted_rank") == "genus", '"').otherwise("")
    marked = raw.withColumn("identified_name", F.concat(opening, "identified_name"))
    species = F.col("accepted_rank") == "species"
    base = scratch_dir(spark)
    options = {"sep": "\t", "null_value": "", "quoting": False}
    write_csv(marked.where(species), f"{base}/species", **options)
    write_csv(marked.where(~species).select(*reversed(raw.columns)), f"{base}/others", **options)
    supplier = src.table(spark, sf_dir, "supplier")
    supplier.select(F.lit(NO_RECORDS).alias("value")).write.text(f"{base}/empty")
    write_csv(supplier.select(F.col("s_suppkey").alias(raw.columns[0]), F.col("s_name").alias(raw.columns[1])), f"{base}/narrow", **options)
    folders = [f"{base}/{f}" for f in ("species", "others", "empty", "narrow")]
    got = read_occurrences(spark, folders, quoting=False, schema=raw.schema)
    return got.groupBy("accepted_rank", F.startswith("identified_name", F.lit('"')).alias("quoted")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("identified_name").alias("names"), F.count("late_interval").alias("late"),
        F.round(F.sum("max_ma"), 3).alias("max_ma"), F.round(F.sum("lng"), 3).alias("lng"), F.sum(F.length("accepted_name")).alias("length"))
