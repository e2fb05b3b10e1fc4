"""Projection, filter, cast, arithmetic, pivot and count queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataframe.functions import numeric, text
from strataframe.operators import aggregates as agg
from strataframe.operators.reshape import flatten, lower_names, pivot_counts, pivot_values, strings_of
from strataframe.workload import inputs as src, query
from strataframe.workload.common import rounded
from strataframe.workload.inputs import with_


@query("project_rename", """
SELECT p_name AS taxa, p_partkey AS id, p_size / 2.0::DOUBLE AS size_m, lower(p_type) AS type, p_brand AS brand FROM part""")
def project_rename(spark, sf_dir):
    part = src.table(spark, sf_dir, "part")
    upper = part.toDF(*[c.upper() for c in part.columns])
    df = lower_names(upper).drop("p_retailprice").withColumns({
        "size_m": F.col("p_size") / 2, "type": F.lower("p_type")})
    df = df.withColumnsRenamed({"p_name": "taxa", "p_partkey": "id", "p_brand": "brand"})
    return df.select("taxa", "id", "size_m", "type", "brand")


@query("select_by_position", "SELECT c_custkey, count(*) AS n FROM customer GROUP BY 1")
def select_by_position(spark, sf_dir):
    customer = src.table(spark, sf_dir, "customer")
    return customer.select(customer.columns[0]).groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("apply_across", """
SELECT c_custkey, lower(c_name) AS c_name, c_nationkey, round(c_acctbal, 6) AS c_acctbal, lower(c_mktsegment) AS c_mktsegment FROM customer""")
def apply_across(spark, sf_dir):
    customer = src.table(spark, sf_dir, "customer")
    return rounded(customer.withColumns({c: F.lower(c) for c in strings_of(customer)}))


@query("filter_suite", """
SELECT c_mktsegment, count(*) AS n, count(*) FILTER (c_acctbal >= 1000 AND c_nationkey = 7) AS both_hold,
  count(*) FILTER (c_mktsegment IN ('BUILDING', 'MACHINERY')) AS listed, count(*) FILTER (c_acctbal <> c_nationkey) AS differing,
  count(*) FILTER (upper(c_mktsegment) <> split_part(c_name, '#', 1)) AS derived
FROM customer WHERE c_acctbal > 0 GROUP BY 1""")
def filter_suite(spark, sf_dir):
    c = src.table(spark, sf_dir, "customer").where(F.col("c_acctbal") > 0)
    return c.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((F.col("c_acctbal") >= 1000) & (F.col("c_nationkey") == 7)).alias("both_hold"),
        F.count_if(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).alias("listed"),
        F.count_if(F.col("c_acctbal") != F.col("c_nationkey")).alias("differing"),
        F.count_if(F.upper("c_mktsegment") != F.substring_index("c_name", "#", 1)).alias("derived"))


@query("word_count_filter", r"""
SELECT p_brand, count(*) FILTER (len(regexp_extract_all(p_name, '[^\t\n\f\r\p{Z}]+')) = 2) AS two_words, count(*) AS n FROM part GROUP BY 1""")
def word_count_filter(spark, sf_dir):
    return src.table(spark, sf_dir, "part").groupBy("p_brand").agg(
        F.count_if(text.token_count(F.col("p_name")) == 2).alias("two_words"), F.count(F.lit(1)).alias("n"))


@query("limits_filter", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events WHERE value BETWEEN 1 AND 30 GROUP BY 1")
def limits_filter(spark, sf_dir):
    kept = src.table(spark, sf_dir, "events").where(F.col("value").between(1, 30))
    return rounded(kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value")))


@query("named_counts", "SELECT o_orderpriority, o_orderstatus, count(*) AS nr_FAD FROM orders GROUP BY 1, 2")
def named_counts(spark, sf_dir):
    return agg.counts(src.table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"], "nr_FAD")


@query("distinct_sets", "SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders")
def distinct_sets(spark, sf_dir):
    return src.table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus").distinct()


@query("distinct_rows", "SELECT count(*) AS n FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_quantity, l_discount FROM lineitem)")
def distinct_rows(spark, sf_dir):
    rows = src.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount")
    return rows.distinct().agg(F.count(F.lit(1)).alias("n"))


@query("global_sums", """
SELECT CAST(sum(l_quantity) AS BIGINT) AS total, min(l_linenumber) AS lowest, max(l_linenumber) AS highest, count(*) AS n FROM lineitem""")
def global_sums(spark, sf_dir):
    return src.table(spark, sf_dir, "lineitem").agg(
        F.sum("l_quantity").cast("long").alias("total"), F.min("l_linenumber").alias("lowest"),
        F.max("l_linenumber").alias("highest"), F.count(F.lit(1)).alias("n"))


@query("ratio_of_counts", """
SELECT o_orderpriority, round(count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 100000) / count(*) FILTER (o_orderstatus = 'F'), 6) AS share
FROM orders GROUP BY 1""")
def ratio_of_counts(spark, sf_dir):
    done = F.col("o_orderstatus") == "F"
    return rounded(src.table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        agg.ratio_of_counts(done & (F.col("o_totalprice") > 100000), done).alias("share")))


@query("mean_per_key", "SELECT l_suppkey, round(avg(l_quantity), 6) AS mean_quantity FROM lineitem GROUP BY 1")
def mean_per_key(spark, sf_dir):
    return rounded(src.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("mean_quantity")))


@query("flatten_lists", """
SELECT vec_id, count(*) AS n, round(sum(v), 4) AS total FROM (
  SELECT vec_id, unnest(CASE WHEN label = 3 THEN [] ELSE list_transform(embedding, lambda x: CAST(x AS DOUBLE)) END) AS v FROM embeddings) GROUP BY 1""")
def flatten_lists(spark, sf_dir):
    cell = F.when(F.col("label") == 3, F.array().cast("array<float>")).otherwise(F.col("embedding"))
    e = src.table(spark, sf_dir, "embeddings").select("vec_id", cell.alias("v"))
    flat = flatten(e, "v").groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("v").cast("double")).alias("total"))
    return flat.withColumn("total", F.round("total", 4) + F.lit(0.0))


@query("pivot_collision", """
SELECT user_id, """ + ", ".join(f"round(avg(value) FILTER (event_type = '{t}'), 6) AS mean_{t}" for t in ("click", "view", "purchase", "signup", "error"))
    + " FROM events GROUP BY 1")
def pivot_collision(spark, sf_dir):
    return rounded(pivot_values(src.table(spark, sf_dir, "events"), ["user_id"], "event_type",
                                ["click", "view", "purchase", "signup", "error"], {"mean": F.avg("value")}))


@query("pivot_counts_fill", """
SELECT user_id, count(*) FILTER (event_type = 'error') AS error, """ + ", ".join(
    f"nullif(count(*) FILTER (event_type = '{t}'), 0) AS {t}" for t in ("click", "view", "purchase", "signup")) + " FROM events GROUP BY 1")
def pivot_counts_fill(spark, sf_dir):
    events = src.table(spark, sf_dir, "events")
    return pivot_counts(events, ["user_id"], "event_type", ["error", "click", "view", "purchase", "signup"], zero_fill=["error"])


@query("math_suite", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(ln(l_extendedprice), 6) AS log_price, round(ln(1 + l_quantity), 6) AS log1p_quantity,
  round(exp(l_discount) - 1, 6) AS expm1_discount, round((exp(l_tax) - 1) * 100, 6) AS percent_change,
  round((l_extendedprice - l_quantity) / 2 + l_quantity, 4) AS midpoint, l_discount BETWEEN 0.02 AND 0.05 AS in_range FROM lineitem""")
def math_suite(spark, sf_dir):
    li = src.table(spark, sf_dir, "lineitem")
    r6 = lambda c: F.round(c, 6)
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(F.log("l_extendedprice")).alias("log_price"),
        r6(F.log1p("l_quantity")).alias("log1p_quantity"), r6(F.expm1("l_discount")).alias("expm1_discount"),
        r6(numeric.percent_change(F.col("l_tax"))).alias("percent_change"),
        F.round(numeric.age_midpoint(F.col("l_extendedprice"), F.col("l_quantity")), 4).alias("midpoint"),
        F.col("l_discount").between(0.02, 0.05).alias("in_range"))


@query("cast_suite", r"""
SELECT event_id, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k, TRY_CAST(event_type AS DOUBLE) AS no_number,
  coalesce(TRY_CAST(event_type AS DOUBLE), 0) AS filled, CAST(user_id AS VARCHAR) AS user_text FROM events""")
def cast_suite(spark, sf_dir):
    number = F.col("event_type").try_cast("double")
    return src.table(spark, sf_dir, "events").select(
        "event_id", F.regexp_extract("props", r"([0-9]+)", 1).try_cast("double").alias("k"), number.alias("no_number"),
        F.coalesce(number, F.lit(0.0)).alias("filled"), F.col("user_id").cast("string").alias("user_text"))


@query("drop_and_fill", with_(src.TRAITS_SQL, """
SELECT "group", count(*) FILTER (guild IS NOT NULL AND vertical IS NOT NULL) AS kept, sum(coalesce(age_late_epoch, 0)) AS filled_sum
FROM traits GROUP BY 1"""))
def drop_and_fill(spark, sf_dir):
    t = src.traits(spark, sf_dir)
    whole = F.col("guild").isNotNull() & F.col("vertical").isNotNull()
    return t.groupBy("group").agg(F.count_if(whole).alias("kept"), F.sum(F.coalesce("age_late_epoch", F.lit(0.0))).alias("filled_sum"))


@query("replace_first_blank", "SELECT doc_id, CASE WHEN strpos(text, ' ') = 0 THEN text ELSE split_part(text, ' ', 1) || '%20' || text[strpos(text, ' ') + 1:] END AS escaped FROM documents")
def replace_first_blank(spark, sf_dir):
    d = src.table(spark, sf_dir, "documents")
    return d.select("doc_id", text.replace_first(F.col("text"), " ", "%20").alias("escaped"))
