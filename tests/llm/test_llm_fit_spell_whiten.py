"""Best-fit packing, spelling variants and whitening against brute force, and on messy and empty tables."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strataframe.llm.best_fit import WordEncoder, best_fit, pack_best_fit, sweep
from strataframe.llm.shared import flat_bytes
from strataframe.llm.spelling import near_words, pivots, prefix, spelling_forms
from strataframe.llm.whitening import whiten

PATH = public_tokenizers.path("word_bpe_49k.json")

import pyarrow as pa  # noqa: E402


# Best fit

def test_word_encoder_equals_tokenizer():
    tok = Tokenizer.from_file(PATH)
    rng = random.Random(1)
    words = ["don't", "l'été", "İstanbul", "x y", "éa", "<|endoftext|>", "!İ", "12a3", "…'s", "ß", "naïve", "日本語", "a<|startoftext|>b", "'ll'", " ", "Ω"]
    texts = ["", " \n\t ", *words] + [rng.choice(["", " ", "\n"]) + "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\x0b", "\x1c", ""]) for _ in range(40)) for _ in range(60)]
    encode = WordEncoder(PATH)
    for _ in range(2):
        got = encode(*flat_bytes(pa.array(texts)))
        assert [np.frombuffer(g, np.uint32).tolist() for g in got] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def check_pack(rows, texts, capacity):
    tok = Tokenizer.from_file(PATH)
    ids = [np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], np.uint32) for t in texts]
    want = Counter()
    by_doc = {}
    for (d, _), own in zip(rows, ids):
        for p, at in enumerate(range(0, len(own), capacity)):
            part = own[at:at + capacity]
            want[d, p, at, len(part), zlib.crc32(part.tobytes())] += 1
    return want, sum(map(len, ids))


def test_pack_best_fit(messy, scratch):
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    out = pack_best_fit(messy, PATH, scratch).collect()
    want, total = check_pack(rows, [t for _, t in rows], 4096)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    used = {}
    for r in sorted(out, key=lambda r: r.offset):
        assert used.get(r.sequence_id, 0) == r.offset
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 4096 and sum(used.values()) == total
    assert len(used) == -(-total // 4096)


@pytest.mark.parametrize("seed,capacity,draw", [(1, 4096, lambda r: min(4096, int(r.lognormvariate(5, 1.3)) + 1)), (2, 100, lambda r: r.randrange(34, 51)),
                                                (3, 64, lambda r: 33), (4, 50, lambda r: r.choice([1, 1, 1, 30])), (5, 128, lambda r: r.choice([1, 64, 65, 128]))])
def test_best_fit_is_near_the_bound(spark, scratch, seed, capacity, draw):
    rng = random.Random(seed)
    sizes = [draw(rng) for _ in range(3000)]
    items = spark.createDataFrame(list(enumerate(sizes)), "item long, length long").repartition(5)
    out = best_fit(items, scratch, capacity).collect()
    assert sorted(r.item for r in out) == list(range(3000))
    used = {}
    for r in sorted(out, key=lambda r: (r.bin, r.offset)):
        assert used.get(r.bin, 0) == r.offset
        used[r.bin] = r.offset + sizes[r.item]
    assert max(used.values()) <= capacity
    # Best-fit decreasing, one piece at a time.
    gaps = Counter()
    opened = 0
    for s in sorted(sizes, reverse=True):
        g = min((g for g in gaps if g >= s and gaps[g]), default=None)
        if g is None:
            opened, g = opened + 1, capacity
        else:
            gaps[g] -= 1
        gaps[g - s] += 1
    assert len(used) <= opened * 1.01 + 1


def test_sweep_takes_the_smallest_gap():
    assert sweep({5: 2, 3: 1}, {5: 4}, {9: 1, 6: 1, 4: 1, 2: 3}) == [(6, 0, 1, 5, 4), (9, 0, 1, 5, 5), (4, 0, 1, 3, 0)]
    assert sweep({5: 3}, {}, {4: 9}) == []


def test_pack_best_fit_empty(nothing, scratch):
    assert pack_best_fit(nothing, PATH, scratch).count() == 0


# Spelling

def edits(a, b):
    """Whether one inserted, deleted or replaced letter makes a of b."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i + 1:] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1:]


def forms(rows, drop):
    n = Counter()
    for d, t in rows:
        low = (t or "").translate({i: i + 32 for i in range(65, 91)})
        for w in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % drop == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near = {w: [v for v in n if edits(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def test_spelling_forms(spark, scratch, messy):
    rng = random.Random(3)
    base = ["".join(rng.choice("abé") for _ in range(rng.randrange(5, 9))) for _ in range(60)] + ["ÀÉçñüÿ", "letters", "lettérs", "LETTERS", "aaaaaa", "aaaaaaa"]
    weights = [5 ** rng.randrange(0, 5) for _ in base]
    rows = [(i if i % 11 else None, rng.choice([" ", "-", "1", "\n"]).join(rng.choices(base, weights, k=300))) for i in range(60)] + [(r.doc_id, r.text) for r in messy.collect()]
    rows += [rows[0], (9, "x" * 100_000 + " short"), (10, "Ω" + "abcdef " * 7)]
    out = spelling_forms(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), scratch, drop_every=7)
    want = forms(rows, 7)
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in out.collect()} == want
    assert any(f and r != f for _, f, r, *_ in want) and out.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_near_words_are_all_found(spark, scratch):
    rng = random.Random(4)
    words = {"".join(rng.choice("ab") for _ in range(rng.randrange(4, 10))) for _ in range(400)} | {"aaaa", "aaaaa", "abababab", "ababab", "abababa"}
    out = near_words(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), scratch).collect()
    assert Counter((r.word, r.near) for r in out) == Counter((a, b) for a in words for b in words if edits(a, b))


def test_pivots_are_disjoint_and_cheapest():
    rng = random.Random(5)
    for _ in range(300):
        word = "".join(rng.choice("abc") for _ in range(rng.randrange(4, 12)))
        order = {x + y: rng.randrange(5) for x in "abc" for y in "abc"}
        grams, _ = prefix(word, order)
        a, b = pivots(grams)
        cost = {i: f for i, f, _ in grams}
        assert b >= a + 2 and cost[a] + cost[b] == min(cost[x] + cost[y] for x in cost for y in cost if y >= x + 2)


def test_spelling_empty(nothing, scratch):
    assert spelling_forms(nothing, scratch).count() == 0


# Whitening

def check_whiten(rows, out, count):
    x = np.array([[int(np.floor(1024 * float(c))) + 100000 for c in v] for _, v in rows], object)
    n = len(x)
    s = x.sum(axis=0)
    y = (n * x - s)
    centred = y.astype(float) / n
    cov = centred.T @ centred / n
    e, vec = np.linalg.eigh(cov)
    e, vec = e[::-1], vec[:, ::-1]
    by = {}
    for r in out:
        by.setdefault(r.component, []).append(r)
    assert sorted(by) == list(range(1, count + 1))
    deviation = sorted((i, int(d)) for (i, _), d in zip(rows, (y * y).sum(axis=1)))
    for c, got in by.items():
        assert sorted((r.vec_id, int(r.deviation)) for r in got) == deviation and {r.n for r in got} == {n}
        assert all(abs(r.explained - e[c - 1] / np.trace(cov)) < 1e-6 * r.explained for r in got)
        want = dict(zip([i for i, _ in rows], centred @ vec[:, c - 1] / np.sqrt(e[c - 1])))
        a, b = np.array([r.whitened for r in got]), np.array([want[r.vec_id] for r in got])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
        assert all(r.identity_error < 1e-9 for r in got)


def test_whiten(spark, scratch):
    rng = np.random.default_rng(6)
    data = rng.standard_normal((500, 20)) * np.linspace(3, 0.2, 20)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(data)]
    bad = [(900, None), (901, [float("nan")] + [0.0] * 19), (902, [float("-inf")] * 20), (903, [None] + [1.0] * 19), (904, []), (905, [1.0, 2.0]), (906, [1e30] * 20)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("x", F.lit("clash")).withColumn("n", F.lit(1)).repartition(4)
    out = whiten(df, scratch).collect()
    check_whiten(rows, out, 8)
    single = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    check_whiten([(r.vec_id, r.embedding) for r in single.collect()], whiten(single, scratch, components=3).collect(), 3)


def test_whiten_stops_early_with_many_dimensions(spark, scratch):
    rng = np.random.default_rng(7)
    data = rng.standard_normal((600, 300)) * (40 * 0.7 ** np.arange(300) + 0.01)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(data)]
    check_whiten(rows, whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), scratch, components=4).collect(), 4)


def test_whiten_without_variance(spark, scratch):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    out = whiten(df, scratch).collect()
    assert len(out) == 6 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.identity_error is None for r in out)
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], "vec_id long, embedding array<double>")
    out = whiten(line, scratch).collect()
    assert {r.component: r.whitened is None for r in out} == {1: False, 2: True, 3: True}
    assert {round(r.explained, 9) for r in out} == {1.0, 0.0} and max(r.identity_error for r in out) < 1e-9
    repeated = spark.createDataFrame([(i, [float(i % 2), float(i // 2 % 2), float(i // 4)]) for i in range(8)], "vec_id long, embedding array<double>")
    assert max(r.identity_error for r in whiten(repeated, scratch).collect()) < 1e-9


def test_whiten_large_numbers_are_exact(spark, scratch):
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-1, 1) * 2.0 ** 37, rng.uniform(-1, 1) * 2.0 ** 30]) for i in range(3000)]
    check_whiten(rows, whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), scratch).collect(), 2)


def test_whiten_empty(spark, scratch):
    assert whiten(spark.createDataFrame([], "vec_id long, embedding array<float>"), scratch).count() == 0
