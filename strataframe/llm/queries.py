"""The registered queries of this package, each an operator on its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from strataframe.llm.best_fit import pack_best_fit
from strataframe.llm.jaccard_join import jaccard_classes
from strataframe.llm.mixing import Mix
from strataframe.llm.order_minhash import fingerprints
from strataframe.llm.packing import pack
from strataframe.llm.risk_thresholds import judge
from strataframe.llm.role_repair import repair_roles
from strataframe.llm.shared import Scratch, table
from strataframe.llm.spelling import spelling_forms
from strataframe.llm.suffix_dedup import remove_repeats
from strataframe.llm.toxicity import held_out, score, train
from strataframe.llm.url_filter import judge_urls
from strataframe.llm.warc_index import merge_index, read_archives, write_archives
from strataframe.llm.whitening import whiten

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return register


@query("op8_jaccard_join")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"), Scratch(spark), width=3, percent=90)


OP10_SQL = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, length(h) // 2 AS n_bytes FROM t),
p AS (SELECT doc_id, unnest(range(n_bytes - 49)) AS i, h FROM n WHERE n_bytes >= 50),
s AS (SELECT doc_id, i, h[2 * i + 1 : 2 * i + 100] AS g FROM p),
m AS (SELECT g, min(doc_id) AS first_doc FROM s GROUP BY g HAVING count(DISTINCT doc_id) > 1),
c AS (SELECT s.doc_id, s.i, lag(s.i) OVER (PARTITION BY s.doc_id ORDER BY s.i) AS before
      FROM s JOIN m ON s.g = m.g WHERE s.doc_id > m.first_doc),
r AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END)
      OVER (PARTITION BY doc_id ORDER BY i) AS run FROM c),
x AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM r GROUP BY doc_id, run),
y AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM x),
z AS (SELECT y.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last_end,
             string_agg(n.h[2 * before + 1 : 2 * a], '' ORDER BY a) AS kept
      FROM y JOIN n ON y.doc_id = n.doc_id GROUP BY y.doc_id)
SELECT n.doc_id, n.n_bytes, CAST(coalesce(z.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(z.n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(z.kept || n.h[2 * z.last_end + 1 :], n.h))) AS kept_sha256
FROM n LEFT JOIN z ON n.doc_id = z.doc_id
"""


@query("op10_suffix_dedup", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), Scratch(spark))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


@query("op9_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op4_mixing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = Mix(table(spark, sf_dir, "documents"), Scratch(spark), weights=(3, 1, 2), total_share=1.5, most_times=2)
    return mix.documents().select("doc_id", "size", "source_size", "target", "taken")


@query("op3_risk_thresholds")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark))


@query("op7_order_minhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


@query("op6_url_filter")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
    return judge_urls(table(spark, sf_dir, "pages"), rules)


@query("op2_role_repair")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_roles(table(spark, sf_dir, "conversations"), Scratch(spark))


@query("op1_warc_index")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    folder = scratch.path("archives")
    # The table has no capture times; the page's number of seconds stands in.
    time = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    manifest = write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html", time.alias("time")), folder, scratch)
    records = read_archives(merge_index(manifest, folder, scratch), folder)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "time")


@query("op11_best_fit")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_best_fit(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), Scratch(spark))


@query("op12_spelling_variants")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(table(spark, sf_dir, "documents"), Scratch(spark), drop_every=199)


@query("op13_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whiten(table(spark, sf_dir, "embeddings"), Scratch(spark))
    # The contract's type; what no long holds is null.
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))
