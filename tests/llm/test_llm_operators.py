"""Operators against brute force, and on messy and empty tables."""

import base64
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter
from math import comb
from pathlib import Path
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strataframe.llm import jaccard_join, role_repair, special, suffix_dedup
from strataframe.llm.hashing import shingle_sets
from strataframe.llm.jaccard_join import Levels, jaccard_classes
from strataframe.llm.mixing import Mix
from strataframe.llm.order_minhash import fingerprints
from strataframe.llm.packing import Encoder, differencing, pack
from strataframe.llm.risk_thresholds import cutoffs, judge
from strataframe.llm.shared import flat_bytes
from strataframe.llm.suffix_dedup import refined, remove_repeats
from strataframe.llm.toxicity import features, fit, held_out, score, train
from strataframe.llm.url_filter import judge_urls
from strataframe.llm.warc_index import LoserTree, merge_index, parse, read_archives, url_key, write_archives

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile("[^\x20\x09-\x0D]+")


def flat(*texts):
    return flat_bytes(pa.array([t.encode() if isinstance(t, str) else t for t in texts], pa.binary()))


# Jaccard join

def classes(rows, width, percent):
    """Brute force: least doc_id reachable."""
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets.append(frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = group[i], group[j]
            group = [a if g == b else g for g in group]
    least = {}
    for (d, _), g in zip(rows, group):
        if d is not None:
            least[g] = min(least.get(g, d), d)
    return Counter((d, len(s), least.get(g) if s else d) for (d, _), g, s in zip(rows, group, sets))


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_jaccard_classes(spark, scratch, messy, width, percent):
    rng = random.Random(width)
    base = [[rng.choice("abcdefghijklmnop") + str(rng.randrange(30)) for _ in range(rng.choice([8, 11, 30, 120]))] for _ in range(12)]
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    for i in range(160):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2, 5])):
            words[rng.randrange(len(words))] = f"z{rng.randrange(50)}"
        rows.append((100 + i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in jaccard_classes(df, scratch, width=width, percent=percent).collect())
    assert got == classes(rows, width, percent)


def test_jaccard_empty(scratch, nothing):
    assert jaccard_classes(nothing, scratch).count() == 0


def test_levels_share_a_key_level():
    for percent in (80, 90):
        levels = Levels(percent)
        for x in range(levels.first, 400):
            for y in range(x, 100 * x // percent + 1):
                common = set(levels.of(x)) & set(levels.of(y))
                assert common or levels.differing(x + y) == 0
                assert all(levels.differing(x + y) < levels.classes(k)[0] for k in common)


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(5)
    slots = rng.choice(np.array([1, 3, 40, 5000, 65535], "<u2"), 1 << 12)
    for percent in (60, 80, 90):
        levels, plans = Levels(percent), {}
        for _ in range(200):
            x = rng.integers(1 << 63, size=int(rng.integers(levels.first, 300)), dtype=np.uint64)
            y = np.r_[x[int(rng.integers(0, max(1, len(x) // 5))):], rng.integers(1 << 63, size=int(rng.integers(0, 30)), dtype=np.uint64)]
            both = len(np.intersect1d(x, y))
            if len(y) < levels.first or 100 * both < percent * (len(x) + len(y) - both):
                continue
            keys = [{(level, k) for level, found in jaccard_join._set_keys(np.sort(s), slots[(np.sort(s) >> np.uint64(50)).astype(int) % len(slots)], levels, plans)
                     for k in found.tolist()} for s in (x, y)]
            assert keys[0] & keys[1]


def test_bitmaps_allow_every_link():
    rng = np.random.default_rng(3)
    for percent in (60, 80):
        sets = []
        for n in (4, 40, 250, 260, 520, 9000):
            base = rng.integers(1 << 63, size=n, dtype=np.uint64)
            sets += [np.sort(np.r_[base[k * n // 40:], rng.integers(1 << 63, size=k * n // 60, dtype=np.uint64)]) for k in range(8)]
        sizes, maps = np.array([len(s) for s in sets]), [jaccard_join.parity(s) for s in sets]
        for blocks in (np.zeros(len(sets), int), np.arange(len(sets)) % 2):
            group = list(range(len(sets)))
            for i, j in jaccard_join.allowed_pairs(sizes, maps, blocks, percent):
                assert not blocks.any() or blocks[i] != blocks[j]
                group = [group[i] if g == group[j] else g for g in group]
            for i, j in itertools.combinations(range(len(sets)), 2):
                both = len(np.intersect1d(sets[i], sets[j]))
                if (not blocks.any() or blocks[i] != blocks[j]) and 100 * both >= percent * (sizes[i] + sizes[j] - both):
                    assert group[i] == group[j]
            assert len(set(group)) >= 6


def test_jaccard_crowds_meet_in_blocks(spark, scratch, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PAIRED", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    rng = random.Random(8)
    line = " ".join(f"c{k}" for k in range(9))
    rows = [(i, " ".join([line, *(f"w{rng.randrange(12)}" for _ in range(3))])) for i in range(60)]
    rows += [(60 + i, " ".join(f"v{k}" if k != i else "other" for k in range(80))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = Counter(tuple(r) for r in jaccard_classes(df, scratch, width=5, percent=80).collect())
    assert got == classes(rows, 5, 80)
    assert spark.read.parquet(*map(str, Path(scratch.folder).glob("*-proposed"))).where("crowd").count()


def test_common_lines_do_not_join_documents(spark, scratch):
    """Texts of unlinked documents are not sent to each other, however many lines are common."""
    rng = random.Random(1)
    lines = [" ".join(f"l{i}x{k}" for k in range(40)) for i in range(300)]
    rows = [(i, "\n".join(rng.sample(lines, 4))) for i in range(600)]
    rows += [(1000 + i, text + " end") for i, text in rows[:7]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter(tuple(r)[::2] for r in jaccard_classes(df, scratch, width=5, percent=80).collect())
    assert got == Counter((i, i - 1000 if i >= 1000 else i) for i, _ in rows)
    assert spark.read.parquet(*map(str, Path(scratch.folder).glob("*-members"))).count() <= 3 * 14


def test_wanted_texts_are_all_kept(spark):
    texts = spark.range(5000).selectExpr("if(id = 7, null, id * id - 900) doc_id", "cast(id as string) text").repartition(3)
    members = texts.where("doc_id % 50 = 0 or doc_id is null").select(F.col("doc_id").alias("rep"))
    kept = jaccard_join._wanted(texts, members)
    assert kept.join(members, F.col("doc_id").eqNullSafe(F.col("rep"))).count() == members.count() and kept.where("doc_id is null").count() == 1
    assert kept.count() <= members.count() + 20 and kept.columns == ["doc_id", "text"]
    assert jaccard_join._wanted(texts, members.limit(0)).count() == 0


# Suffix dedup

def repeats(rows, length):
    starts = {}
    for d, t in rows:
        if d is not None:
            b = (t or "").encode()
            for i in range(len(b) - length + 1):
                starts[b[i:i + length]] = min(starts.get(b[i:i + length], d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        cut = np.zeros(len(b), bool)
        if d is not None:
            for i in range(len(b) - length + 1):
                if starts[b[i:i + length]] < d:
                    cut[i:i + length] = True
        runs = int((cut & ~np.r_[False, cut[:-1]]).sum()) if len(b) else 0
        out.append((d, len(b), int(cut.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~cut])))
    return Counter(out)


def test_remove_repeats(spark, scratch, messy):
    rng = random.Random(3)
    passages = ["".join(rng.choice("abcde é") for _ in range(n)) for n in (49, 50, 51, 80, 300)]
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    for i in range(60):
        text = "".join(rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice("fghi ü") for _ in range(rng.randrange(60))) for _ in range(6))
        rows.append((200 - i, text if i % 9 else rows[-1][1]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = remove_repeats(df, scratch)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.removed), bytes(r.kept)) for r in got.collect())
    assert got == repeats(rows, 50)


def test_remove_repeats_large_buckets_and_shared_ids(spark, scratch, monkeypatch):
    # One line between different neighbours in many documents; a doc_id on two texts, one clean, and on two rows of one text.
    monkeypatch.setattr(suffix_dedup, "RUN_ROWS", 8)
    rng = random.Random(31)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    line = word(90)
    rows = [(i, word(60) + line + word(60)) for i in range(80)]
    rows += [(5, word(112)), (5, rows[5][1]), (90, line[:70] + word(40)), (90, word(112)), (None, line)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = remove_repeats(df, scratch, hot=12)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.removed), bytes(r.kept)) for r in got.collect())
    assert got == repeats(rows, 50)


def test_refined_numbers_equal_strings():
    rng = random.Random(5)
    rows = ["".join(rng.choice("ab") for _ in range(rng.randrange(90))).encode() for _ in range(30)]
    raw, offsets = flat(*rows)
    starts, numbers = refined(raw, offsets, 18)
    strings = [raw[s:s + 18].tobytes() for s in starts]
    assert len(strings) == sum(max(0, len(r) - 17) for r in rows)
    assert len(set(zip(strings, numbers.tolist()))) == len(set(strings)) == len(set(numbers.tolist()))


def test_remove_repeats_empty(scratch, nothing):
    assert remove_repeats(nothing, scratch).count() == 0


# Packing

def test_encoder_equals_tokenizer():
    texts = ["", "Plain words  and   runs \n\n of space. ", "été naïve ÷ × 12ab34 x_y it's <|endoftext|> über", "日本語 text ", "tabs\t\tand\nlines\n", "a" * 3000, " lead"]
    tokenizer = Tokenizer.from_file(PATH)
    got = Encoder(PATH)(*flat(*texts))
    assert [np.frombuffer(g, np.uint32).tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_pack_covers_every_id(messy):
    rows = pack(messy, PATH).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = Counter()
    for r in messy.collect():
        want[(r.doc_id, len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1)] += 1
    got = Counter()
    for r in rows:
        got[(r.doc_id, r.doc_tokens)] += r.length
    assert got == {k: k[1] * n for k, n in want.items()}
    by = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert by.get(r.sequence_id, 0) == r.offset
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 2048
    text = next(r.text for r in messy.collect() if r.doc_id == 7)
    ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [1], np.uint32)
    for r in rows:
        if r.doc_id == 7:
            assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())


def test_pack_empty(nothing):
    assert pack(nothing, PATH).count() == 0


def test_differencing_is_near_equal():
    rng = random.Random(1)
    sizes = [rng.randrange(1, 257) for _ in range(500)]
    windows = differencing(sizes, 30)
    assert sorted(p for _, w in windows for p in w) == list(range(500))
    assert all(s == sum(sizes[p] for p in w) for s, w in windows)
    assert windows[0][0] - windows[-1][0] <= 16


# Quality rules

def test_binomial_and_hypergeometric(spark):
    cases = [(k, n) for n in (1, 5, 40, 300) for k in range(0, n, max(1, n // 7))]
    df = spark.createDataFrame(cases, "k long, n long")
    for r in df.select("k", "n", special.binomial_tail(F.col("k"), F.col("n"), 0.1).alias("p")).collect():
        want = sum(comb(r.n, i) * 0.1 ** i * 0.9 ** (r.n - i) for i in range(r.k + 1))
        assert abs(r.p - want) < 1e-9
    draws = spark.range(4000).select(special.hypergeometric(
        F.lit(50).cast("long"), F.lit(20).cast("long"), F.lit(10).cast("long"), (F.col("id") + 0.5) / 4000).alias("x")).groupBy("x").count().collect()
    for r in draws:
        assert abs(r["count"] / 4000 - comb(20, r.x) * comb(30, 10 - r.x) / comb(50, 10)) < 2e-3


def test_base_counts_and_nulls(scratch, messy, spark):
    labels = spark.createDataFrame([(4, 1, None), (4, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = Counter(tuple(r)[:7] for r in judge(messy, labels, scratch).collect())
    want = Counter()
    for r in messy.collect():
        t = r.text or ""
        w = WORD.findall(t)
        grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        seen, cover = Counter(grams), set()
        for i, g in enumerate(grams):
            if seen[g] > 1:
                cover.update(range(i, i + 5))
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want[(r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover),
              len(w) < 10 or 100 * len(cover) > 20 * len(w))] += 1
    assert got == want


def test_cutoffs_hold_on_good_documents(spark):
    rng = np.random.default_rng(2)
    rows = [(s, bool(i % 2), float(v)) for s in ("a", None) for i, v in enumerate(rng.gamma(2, size=6000))] + [("few", True, 1.0), ("few", False, 2.0)]
    good = spark.createDataFrame(rows, "stratum string, holdout boolean, r double")
    found = {r.stratum: r for r in cutoffs(good, ["r"], limit=0.02, level=0.05).collect()}
    assert set(found) == {"a", None}
    for s, r in found.items():
        fresh = rng.gamma(2, size=200_000)
        assert (fresh > r.cutoff).mean() <= 0.02 and r.holdout == 3000


def test_few_labels_still_reject_what_no_good_document_has(spark):
    # 300 good labels in each of four strata; rules as in the registered query, two of them zero nearly everywhere.
    rng = np.random.default_rng(3)
    rules = ["a", "b", "c", "d"]
    rows = [(s, i % 5 > 0, 0.0, float(0.01 * (rng.random() < 0.02)), float(rng.gamma(1)), float(rng.normal(5, 0.2))) for s in "wxyz" for i in range(300)]
    found = cutoffs(spark.createDataFrame(rows, "stratum string, holdout boolean, a double, b double, c double, d double"), rules).collect()
    cuts = {(r.stratum, r.rule): r.cutoff for r in found}
    assert set(cuts) == {(s, r) for s in "wxyz" for r in rules} and all(r.holdout == 240 for r in found)
    for s in "wxyz":
        held = [r[2:] for r in rows if r[0] == s and r[1]]
        over = sum(any(v > cuts[s, r] for v, r in zip(h, rules)) for h in held)
        assert over == next(r.rejected for r in found if r.stratum == s)
        assert 4 * sum(comb(240, i) * 0.02 ** i * 0.98 ** (240 - i) for i in range(over + 1)) <= 0.05
        assert 0.1 > cuts[s, "a"] and 30 > cuts[s, "d"]


def test_judge_empty(scratch, nothing, spark):
    assert judge(nothing, spark.createDataFrame([], "doc_id long, quality int"), scratch).count() == 0


# Mixing

def test_mix_meets_targets(spark, scratch):
    rng = random.Random(4)
    rows = [(i, "w " * rng.choice([0, 3, 40, 3000]), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(300)]
    rows += [rows[0], rows[5], (None, "x y z", "a"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = Mix(docs, scratch, weights=(3, 1, 2), total_share=1.5, most_times=2)
    out = mix.documents(shard_words=4096).collect()
    assert len(out) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in out)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        full = {s for s in open_ if left * weight[s] / sum(weight[o] for o in open_) > 2 * sizes[s]}
        if not full:
            total = sum(weight[o] for o in open_)
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in full)
        open_ -= full
    taken = Counter()
    for r in out:
        taken[r.source] += r.taken
        assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == sizes[r.source]
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert sorted(map(str, mix.documents(shard_words=4096).collect())) == sorted(map(str, out))
    pieces = mix.pieces(shard_words=4096).collect()
    assert sum(p.words for p in pieces) == sum(taken.values())
    quotas = mix.shards(shard_words=4096).collect()
    blocks = {r.source: r.blocks for r in mix.plan.collect()}
    assert {s: sum(q["count"] for q in quotas if q.source == s) for s in names} == {s: blocks[s] for s in names}
    per_shard = Counter()
    for q in quotas:
        per_shard[q.shard] += q["count"]
    assert max(per_shard.values()) - min(per_shard.values()) <= 1


def test_mix_plan_does_not_grow_with_the_shards(spark, scratch):
    docs = spark.createDataFrame([(i, "w " * 400, f"s{i % 3}") for i in range(60)], "doc_id long, text string, source string")
    mix = Mix(docs, scratch, weights=(3, 1, 2), total_share=1.5, most_times=2)
    plan = lambda words: len(mix.documents(shard_words=words)._jdf.queryExecution().optimizedPlan().toString())
    assert plan(1024) < plan(1 << 20) * 1.05
    taken = lambda words: mix.documents(shard_words=words).agg(F.sum("taken")).first()[0]
    assert taken(1024) == taken(1 << 20)


def test_mix_keeps_repeated_rows_without_words(spark, scratch):
    rows = [(1, None, "a")] * 3 + [(None, " ", "a")] * 2 + [(2, "x y", "a")] * 2 + [(3, "", None)] * 2
    mix = Mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), scratch, weights=(1,), total_share=1.0, most_times=1)
    assert Counter((r.doc_id, r.size, r.taken) for r in mix.documents().collect()) == {(1, 0, 0): 3, (None, 0, 0): 2, (2, 2, 2): 2, (3, 0, 0): 2}


def test_mix_empty(scratch, nothing):
    assert Mix(nothing, scratch, weights=(3, 1, 2), total_share=1.5, most_times=2).documents().count() == 0


# Toxicity

def test_toxicity_finds_planted_words(spark):
    rng = random.Random(6)
    plain = ["".join(rng.choice(["the", "er", "on", "an", "re", "st"]) for _ in range(rng.choice([1, 2, 3]))) for _ in range(400)]
    rows = []
    for i in range(1200):
        words = [rng.choice(plain) for _ in range(120)]
        if i % 4 == 0:
            for _ in range(8):
                words[rng.randrange(120)] = rng.choice(["grimbold", "vexation", "zounderkite"])
        rows.append((i, " ".join(words)))
    rows += [(5000, None), (5001, ""), (None, "the er")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(1200)] + [(4, 1), (None, 1)], "doc_id long, toxic int")
    out = score(docs, train(docs, labels)).withColumn("held", held_out(F.col("doc_id"))).collect()
    assert len(out) == len(rows)
    assert all(r.held == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    right = [(r.score >= 0.5) == (r.doc_id % 4 == 0) for r in out if r.held and r.doc_id < 1200]
    assert np.mean(right) > 0.95
    assert {r.score for r in out if not r.text} == {next(r.score for r in out if r.text == "")}


def test_toxicity_keeps_a_long_list_whole():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    plain, bad = [word() for _ in range(300)], [word() for _ in range(500)]
    toxic = np.array([i % 4 == 0 for i in range(2400)])
    texts = [" ".join([rng.choice(plain) for _ in range(60)] + [rng.choice(bad) for _ in range(40 * int(t))]).encode() for t in toxic]
    model = fit(texts, toxic, 0.25)
    assert len(model.toxic) > 4000 and all(f" {w} ".encode() in model.toxic for w in bad)
    a, b = (c.compress for c in model.compressors())
    held = [" ".join([rng.choice(plain) for _ in range(60)] + [w, *bad[i:i + 4]]).encode() for i, w in enumerate(bad[:100])]
    assert (model.scores(np.array([features(t, a, b) for t in held]))
            > model.scores(np.array([features(" ".join(plain[:64]).encode(), a, b)]))[0]).all()


def test_toxicity_without_labels(messy, nothing, spark):
    docs = messy.drop("score")
    model = train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.score for r in score(docs, model).collect()] == [0.0] * docs.count()
    assert score(nothing.drop("score"), model).count() == 0


# URL filter

def test_url_rules(spark):
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
    urls = {1: "http://A.example.NET/en/1?x", 2: "https://b.example.net/de/", 3: "http://www.example.com/de/4#a", 4: None, 5: "no scheme", 6: "x://org/fr/",
            7: "http://notnet/", 8: "http://net?q://", 9: "", 10: "http://EXAMPLE.com/DE/", 11: "http://q.org/fr"}
    pages = spark.createDataFrame(list(urls.items()) + [(1, urls[1])], "page_id long, url string")
    out = {r.page_id: r for r in judge_urls(pages, rules).collect()}
    assert [out[k].rule for k in range(1, 12)] == ["example.net/en/", "net/", "example.com/de/", None, None, "org/fr/", None, None, None, None, None]
    assert (out[1].host, out[1].path) == ("a.example.net", "/en/1") and (out[8].host, out[8].path) == ("net", "") and out[4].host == out[5].path == ""
    assert {out[k].verdict for k in (1, 6)} == {"allow"} and {out[k].verdict for k in (2, 3)} == {"block"}
    assert judge_urls(pages.limit(0), rules).count() == 0


def test_url_model_learns(spark):
    rng = random.Random(8)
    rows = [(i, f"http://s{i}.{'bad.net' if i % 2 else 'good.org'}/{'casino' if i % 2 else 'wiki'}/{rng.randrange(999)}") for i in range(1500)]
    rows += [(2000, "http://x.com/casino/1"), (2001, "http://x.com/wiki/1")]
    out = {r.page_id: r.verdict for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string"), [("block", "net/"), ("allow", "org/")]).collect()}
    assert out[2000] == "block" and out[2001] == "allow"


# Order MinHash

def test_fingerprints(spark, messy):
    rows = [r for r in messy.select("doc_id", "text").collect() if r.doc_id is not None]
    docs = spark.createDataFrame(list({r.doc_id: r for r in rows}.values()), "doc_id long, text string")
    out = {r.doc_id: r for r in fingerprints(docs).collect()}
    text = {r.doc_id: r.text or "" for r in rows}
    ids = sorted(text, reverse=True)
    for d, n in zip(ids, ids[1:] + ids[:1]):
        h = len(text[d]) // 2
        assert out[d].edited_sha256 == hashlib.sha256((text[d][:len(text[d]) - h] + text[n][:h]).encode()).hexdigest()
        assert out[d].n_chars == len(text[d]) and 0 <= out[d].near_edited <= 1 and 0 <= out[d].near_next <= 1
    assert out[0].fingerprint == out[1].fingerprint and out[6].near_edited > 0
    assert fingerprints(messy).count() == messy.count() and fingerprints(docs.limit(0)).count() == 0


def test_fingerprint_sees_order(spark):
    a, b = " ".join(f"p{i}" for i in range(400)), " ".join(f"q{i}" for i in range(400))
    out = {r.doc_id: r for r in fingerprints(spark.createDataFrame([(3, a + " " + b), (2, b + " " + a), (1, a + " " + b)], "doc_id long, text string")).collect()}
    assert out[3].fingerprint == out[1].fingerprint and 0.2 < out[3].near_next < 0.95


# Role repair

def legal_cost(roles, costs):
    """Least cost by trying all choices, turn by turn over all message sequences."""
    best = {(): 0}
    legal = lambda seq: all(x in role_repair.LEGAL[p] for p, x in zip((0, *seq), seq))
    for role in roles:
        nxt = {}
        for seq, cost in best.items():
            for to in (1, 2, 3):
                base = cost + (0 if role in (0, to) else costs.relabel)
                options = [(seq + (to,), base)] + [(seq + (x, to), base + costs.insert) for x in (1, 2, 3)]
                if seq and seq[-1] == to:
                    options.append((seq, base + costs.merge))
                for s, c in options:
                    if legal(s):
                        nxt[s] = min(nxt.get(s, 1 << 30), c)
        best = nxt
    return min(c + costs.insert * (0 if not s or s[-1] == 3 else 1 if s[-1] == 2 else 2) for s, c in best.items())


def test_role_repair_is_legal_and_cheapest(spark, scratch):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None]), rng.choice(["", None, f"t{t}"])) for c in range(40) for t in range(rng.randrange(1, 6))]
    rows += [(77, t, "user", f"u{t}") for t in range(300)] + [(None, None, None, None), (None, 1, "assistant", "x"), (5, 1, "user", "again"), (5, 1, "user", "again")]
    out = role_repair.repair_roles(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), scratch).collect()
    costs = role_repair.Costs()
    by, source = {}, {}
    for r in out:
        by.setdefault(r.conv_id, []).append(r)
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0, r[2] or "", r[3] or "")):
        source.setdefault(c, []).append(role_repair.ROLES.get(role, 0))
    assert sum(r.turn_no is not None for r in out) == len(rows)
    for c, messages in by.items():
        roles = {}
        for r in messages:
            assert roles.setdefault(r.message_no, r.role) == r.role
        seq = [role_repair.ROLES[roles[i]] for i in range(1, len(roles) + 1)]
        assert all(x in role_repair.LEGAL[p] for p, x in zip([0, *seq], seq)) and seq[-1] == role_repair.ASSISTANT
        paid = sum(costs.merge * ("merge" in r.action) + costs.relabel * ("relabel" in r.action and source is not None) + costs.insert * (r.action == "insert") for r in messages)
        if len(source[c]) < 7:
            free = sum(costs.relabel for r in messages if "relabel" in r.action and r.turn_no is not None and source[c][r.turn_no - 1] == 0)
            assert paid - free == legal_cost(source[c], costs)


def test_role_repair_does_not_depend_on_the_parts(spark, scratch):
    rng = random.Random(19)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool"]), f"{c}.{t}") for c in range(30) for t in range(rng.randrange(1, 12))]
    rows += [(7, t, rng.choice(["user", "assistant"]), f"7.{t}") for t in range(12, 200)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    found = []
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        # Seven hashed tasks read the sorted parts, several each.
        for parts in (1, 7, 24):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            found.append(role_repair.repair_roles(turns, scratch).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    costs, role = role_repair.Costs(), {(c, t): r for c, t, r, _ in rows}
    totals = []
    for out in found:
        numbered = [(r.conv_id, r.turn_no) for r in out if r.turn_no is not None]
        assert len(numbered) == len(set(numbered)) == len(rows)
        total = Counter()
        for r in out:
            total[r.conv_id] += costs.merge * ("merge" in r.action) + costs.insert * (r.action == "insert")
            total[r.conv_id] += costs.relabel * ("relabel" in r.action and role[r.conv_id, r.turn] in role_repair.ROLES)
        totals.append(total)
    # Repairs of equal cost may differ where a part ends.
    assert totals[0] == totals[1] == totals[2]


def test_role_repair_edges_of_two_parts_in_one_task():
    batch = pa.RecordBatch.from_arrays([pa.array([0, 0, 0, 1, 1], pa.int32()), pa.array([1, 2, 3, 3, 4]), pa.array(["user"] * 5)], names=["part", "conv_id", "role"])
    out = next(role_repair._edges(role_repair.Costs())(iter([batch])))
    assert list(zip(out.column("part").to_pylist(), out.column("conv_id").to_pylist())) == [(0, 1), (0, 3), (1, 3), (1, 4)]


def test_role_repair_matrices_chain():
    rng = random.Random(10)
    table = role_repair.moves(role_repair.Costs())
    for _ in range(20):
        roles = [rng.randrange(4) for _ in range(12)]
        cut = rng.randrange(1, 11)
        assert role_repair.chain(role_repair.matrix(roles[:cut], table), role_repair.matrix(roles[cut:], table)) == role_repair.matrix(roles, table)


def test_role_repair_beyond_the_old_cap():
    # 2^25 user turns in one conversation: every second one is relabelled, which costs over 2^22.
    costs = role_repair.Costs()
    table = role_repair.moves(costs)
    rows = role_repair.matrix([role_repair.USER] * 4096, table)
    for _ in range(12):
        rows = role_repair.chain(rows, rows)
    part = lambda k: SimpleNamespace(
        part=k, conv_id=None, turns=1 << 24, costs=[None if c == role_repair.NEVER else c[0] for r in rows for c in r], messages=[c[1] for r in rows for c in r])
    ends = role_repair.boundaries([part(0), part(1)], costs)
    assert rows[role_repair.START][role_repair.ASSISTANT] == (costs.relabel << 23, 1 << 24)
    assert ends == {(0, None): (0, 0, role_repair.START, role_repair.ASSISTANT), (1, None): (1 << 24, 1 << 24, role_repair.ASSISTANT, None)}


def test_role_repair_costs_beyond_the_old_cap_in_one_part(spark, scratch):
    price = 1 << 22
    rows = [(None, t, "user", f"u{t}") for t in range(3)]
    out = role_repair.repair_roles(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), scratch,
                                   costs=role_repair.Costs(price, price, price)).collect()
    assert sorted((r.turn for r in out if r.turn is not None)) == [0, 1, 2] and max(r.message_no for r in out) == 2


def test_role_repair_empty(spark, scratch):
    assert role_repair.repair_roles(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), scratch).count() == 0


# WARC

def test_loser_tree_merges():
    rng = random.Random(11)
    for k in (1, 2, 3, 5, 8, 13):
        runs = [sorted((rng.randrange(50), i) for _ in range(rng.randrange(20))) for i in range(k)]
        assert list(LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)
    assert list(LoserTree([])) == []


def test_warc_round_trip_and_order(spark, scratch):
    rng = random.Random(12)
    rows = [(i, f"http://h{rng.randrange(5)}.org/p{rng.randrange(9)}" if i % 7 else "http://hot.org/", f"2024-01-01T00:{i % 60:02d}:00Z",
             rng.choice(["same", "", None, f"é\r\n\r\n{i}"])) for i in range(400)]
    rows += [rows[3], (None, None, "2024-01-01T00:00:00Z", "same"), (999, "bad url\n", "2024-01-01T00:00:00Z", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, time string, html string").repartition(9)
    folder = scratch.path("archives")
    index = merge_index(write_archives(pages, folder, scratch), folder, scratch, range_rows=50, fan_in=3)
    keys = [(r.urlkey, r.time, r.archive, r.offset) for r in index.orderBy("part", "place").collect()]
    assert keys == sorted(keys) and len(keys) == len(rows) and index.select("part").distinct().count() > 3
    first = {}
    for i, _, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = Counter((i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(),
                    first[h or ""] if i is not None and i > first[h or ""] else None) for i, _, _, h in rows)
    out = read_archives(index, folder).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.refers_to) for r in out) == want
    assert all((r.record_type == "revisit") == (r.refers_to is not None) for r in out)
    html = {i: (h or "").encode() for i, _, _, h in rows}
    assert all(bytes(r.payload) == html[r.page_id] for r in out if r.record_type == "response" and r.page_id is not None)


def test_warc_empty_and_small_payloads(spark, scratch):
    schema = "page_id long, url string, time string, html string"
    folder = scratch.path("archives")
    assert read_archives(merge_index(write_archives(spark.createDataFrame([], schema), folder, scratch), folder, scratch), folder).count() == 0
    rows = [(1, "http://a", "2024-01-01T00:00:00Z", "xy"), (2, "http://a", "2024-01-01T00:00:00Z", "xy")]
    out = read_archives(merge_index(write_archives(spark.createDataFrame(rows, schema), folder, scratch, min_bytes=3), folder, scratch), folder)
    assert {r.record_type for r in out.collect()} == {"response"}


def test_url_key():
    assert url_key("HTTP://User@WWW.Example.com:80/A?b#c") == "com,example,www)/A?b"
    assert url_key("https://a.b:8080") == "b,a:8080)/" and url_key(None) == ""
    assert parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nh\r\n\r\nabcd\r\n\r\n") == ({"Content-Length": "9"}, b"h", b"abcd")


def test_oracles_of_the_package(spark, scratch):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(entry.oracle_sql()["op10_suffix_dedup"]).fetchall()
    cols = [d[0] for d in con.description]
    got = entry.queries()["op10_suffix_dedup"](spark, sf).select(*cols).collect()
    assert sorted(want) == sorted(map(tuple, got))


def test_shingle_sets_short_rows():
    raw, offsets = flat("a b", "", "A  B", "a b c", "\t", "b a")
    sets = shingle_sets(raw, offsets, 3)
    assert [len(s) for s in sets] == [1, 0, 1, 1, 0, 1]
    assert sets[0] == sets[2] and sets[0] != sets[5]


def test_packing_encodes_word_pieces_together():
    import public_tokenizers

    from strataframe.llm import packing

    encode = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    words = [f"{lead}{core}{i}" for i in range(700) for lead in ("", " ") for core in ("pal\u00e9o", "!?", "Zx", "\u4e2d")]
    words += ["\n", "\n\n", " ", "   ", "\t", "\r", "\r\n", "a", " a", "--", " --"]
    asked = []
    alone, encode._texts = encode._texts, lambda texts: asked.extend(texts) or alone(texts)
    assert encode._pieces(words) == alone(words)
    assert len(asked) < len(words) / 50
    assert encode._pieces([]) == []
