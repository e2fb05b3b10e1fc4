"""Stages of the corpus pipeline on nulls, repeated ids and empty tables, against brute force where a stage is exact."""

from collections import Counter

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

from test_llm_operators import classes, repeats

COLUMNS = list(pipeline.COLUMNS)


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    """A folder of tables: labels for the toxicity stage."""
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, 1, int(i % 2)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def docs(spark):
    passage = "the quick brown fox jumps over the lazy dog and then runs far away from here "
    rows = [(i, f"{passage}number {i} " + " ".join(f"w{i * 31 + j}" for j in range(60)), "en", f"s{i % 3}", 1) for i in range(30)]
    copy = " ".join(f"c{j}" for j in range(80))
    rows += [(40, copy, "en", "s0", 1), (41, copy + " end", None, "s1", 1), (41, copy + " end", None, "s1", 1), (42, copy + " end", "de", None, None)]
    rows += [(50, None, None, None, None), (51, "", "en", "s1", 0), (None, copy, "en", "s2", 1), (None, None, None, None, None), (3, "short text of its own", "en", "s0", 1), (52, "é " * 300, "fr", "s2", 600)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def counted(df):
    return Counter(map(tuple, df.select(*COLUMNS).collect()))


@pytest.mark.parametrize("name, stage", pipeline.STAGES)
def test_stage_on_an_empty_table(spark, docs, folder, name, stage):
    out = stage(spark, docs.limit(0), folder)
    assert out.count() == 0 and (name == "pack" or out.columns == COLUMNS)


def test_clean_documents_pass_the_toxicity_stage(spark, docs, folder):
    # The labels are noise here: whatever is kept is kept as it was, and nothing is made up.
    kept, given = counted(pipeline.drop_toxic(spark, docs, folder)), counted(docs)
    assert not kept - given


def test_one_document_of_each_class_stays(spark, docs, folder):
    got = counted(pipeline.drop_near_copies(spark, docs, folder))
    least = {}
    for (d, _, c), _ in classes([(r.doc_id, r.text) for r in docs.collect()], 5, 80).items():
        least.setdefault(d, set()).add(c)
    want = Counter({row: n for row, n in counted(docs).items() if row[0] is None or all(c is None or c >= row[0] for c in least[row[0]])})
    assert got == want and not any(r[0] in (41, 42) for r in got)


def test_repeated_passages_go(spark, docs, folder):
    given = [(r.doc_id, r.text) for r in docs.collect()]
    want = Counter()
    for (d, n_bytes, removed, _, kept), n in repeats(given, 50).items():
        if removed < n_bytes or n_bytes == 0:
            want[d, kept.decode("utf-8", "ignore")] += n
    out = pipeline.drop_repeats(spark, docs, folder).collect()
    assert Counter((r.doc_id, r.text or "") for r in out) == want
    assert all(r.n_chars == len(r.text) for r in out if r.doc_id is not None and 0 < r.doc_id < 30 and r.text.startswith("number"))


def test_mix_keeps_rows_whole_and_repeats_itself(spark, docs, folder):
    first, again = (counted(pipeline.mix_sources(spark, docs, folder)) for _ in range(2))
    given = counted(docs)
    assert first == again and set(first) <= set(given)
    assert all(n <= 2 * given[row] for row, n in first.items())
    # Sources without words, and rows without, are never taken.
    assert not any(not (row[1] or "").split() for row in first)


def test_pack_takes_every_row(spark, docs, folder):
    out = pipeline.pack_sequences(spark, docs, folder)
    assert out.where("start = 0").count() == docs.count()
    used = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("top"))
    assert used.where("n <> top or n > 2048").count() == 0


def test_run_chains_the_stages(spark, tmp_path, docs, folder):
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0
