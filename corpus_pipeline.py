"""A corpus from raw documents: toxic texts out, near copies out, repeated passages out, sources mixed, sequences packed.

Every stage takes and, but for the last, returns the columns of ``documents``. A stage takes a null or empty text as it takes any
other; what is defined for nulls, ties and repeated rows is said in the operators.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from strataframe.llm.jaccard_join import jaccard_classes
from strataframe.llm.mixing import Mix
from strataframe.llm.packing import pack
from strataframe.llm.shared import Scratch, table
from strataframe.llm.suffix_dedup import remove_repeats
from strataframe.llm.toxicity import score, train

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Texts this likely to be toxic go.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated score is below ``TOXIC``; the model is fitted on labelled rows of ``docs``."""
    docs = docs.select(*COLUMNS)
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).where(F.col("score") < TOXIC).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each class of near copies (5-word shingles, similarity 0.8 or more).

    Rows that share a doc_id stay or go together; rows without a doc_id stay.
    """
    classes = jaccard_classes(docs, Scratch(spark), width=5, percent=80)
    gone = classes.where("doc_id > component_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 50-byte strings that also start in a document with a smaller doc_id.

    A character that loses some of its bytes goes as a whole; ``n_chars`` counts what is left, and texts with nothing left go.
    """
    out = remove_repeats(docs.select(*COLUMNS), Scratch(spark), as_text=True,
                         extra=[F.col("lang"), F.col("source"), F.col("n_chars"), F.col("text").isNull().alias("no_text")])
    out = out.withColumn("text", F.when(~F.col("no_text"), F.col("kept")))
    return out.where("n_removed < n_bytes or n_bytes = 0").select(
        "doc_id", "text", "lang", "source", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Of a pass that takes a part of a document's words, the whole
    document is taken with the part's share as its chance, by a hash of the document; so sources come near their targets.

    Sources weigh 3, 1, 2 in turn, share 150 % of all words, and stop at twice their size; what has no words is never taken.
    """
    mix = Mix(docs, Scratch(spark), weights=(3, 1, 2), total_share=1.5, most_times=2)
    share = F.col("taken") / F.col("size")
    chance = F.pmod(F.xxhash64(F.lit("copy"), "doc_id", "source"), F.lit(1 << 30)) / float(1 << 30)
    times = mix.documents().where("taken > 0").groupBy("doc_id", "source").agg(
        F.max((F.floor(share) + (chance < share - F.floor(share)).cast("int")).cast("int")).alias("times")).where("times > 0")
    joined = docs.select(*COLUMNS).alias("d").join(
        times.alias("t"), F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & F.col("d.source").eqNullSafe(F.col("t.source")))
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*[F.col(f"d.{c}") for c in COLUMNS])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeats", drop_repeats),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: Tokens, trained models and hashed draws are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
