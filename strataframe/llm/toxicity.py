"""Toxicity by compression distance.

Two zstandard dictionaries are used. The ordinary one is trained on ordinary text. The toxic one is not trained: it is the whole list
of the words whose beginnings are much more frequent in toxic than in ordinary text, most frequent first, joined raw. It decides what saves
bytes, so the method is a list of words weighed by compression. Dictionaries trained on whole toxic texts found few toxic texts, since
nearly all of a toxic text is ordinary (figures in the README);
each short window of whole words is compressed with the ordinary dictionary and with the toxic one put on top of
it, and the bytes saved are counted at several thresholds. Both start with one passage that both dictionaries end in, so that a
single short word more is seen in the length, and the ordinary dictionary is filled up to the same length, so that nothing but
toxic words makes a difference. A logistic model on a second half of the
labelled sample calibrates these counts, normalised by the text's length, to a score.

The fit takes a sample of labelled rows bounded by ``per_class`` (rows of each class, of at most ``FIT_BYTES``
bytes each); scoring covers every window of every whole text. Labels, language, source and doc_id are no inputs of a score.

Defined results: a null or empty text has no window and gets the score of a text without any saving; rows with one doc_id are
scored alike; several labels of one doc_id count as toxic if one is; without labels of both classes every score is 0; further
columns stay as they are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import Column, DataFrame, functions as F

from strataframe.llm.shared import flat_bytes, released

#: Labelled rows of each class in the fit, about.
PER_CLASS = 4000
FIT_BYTES = 1 << 16
#: A window: this many bytes, to the end of the word (of at most 64 bytes more).
WINDOW = re.compile(rb"[\s\S]{1,12}\S{0,64}\s*")
CARRIER = bytes(range(128, 160)) + b" "
#: Bytes saved in a window, from which it counts.
STEPS = np.arange(1, 9)
ORDINARY_BYTES = 14_000
#: A word beginning is toxic if this share of toxic texts has it, and that many times the share of ordinary ones.
TOXIC_SHARE, TOXIC_RATIO = 0.015, 25
#: A word with such a beginning is in the dictionary if it occurs this often for each toxic text.
WORD_SHARE = 0.003


def held_out(doc_id: Column) -> Column:
    """Rows that no fit sees: crc32 of the doc_id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _beginnings(text: bytes) -> set[bytes]:
    out = set()
    for word in set(text.split()):
        word = b" " + word
        for n in range(5, 9):
            if len(word) >= n:
                out.add(word[:n])
    return out


def _windows(text: bytes) -> list[bytes]:
    return [CARRIER + w for w in WINDOW.findall(text)]


def _trained(samples: list[bytes], size: int) -> bytes:
    """Content of a trained dictionary; of few samples, the samples."""
    try:
        return zs.train_dictionary(size, samples, k=32, d=8).as_bytes()[-size:]
    except zs.ZstdError:
        return b"".join(samples)[:size]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def compressors(self) -> tuple:
        out = []
        # The window and its tables hold both dictionaries, however long the list.
        log = max(15, (len(self.ordinary) + len(self.toxic) + 1024).bit_length())
        for content in (self.ordinary + bytes(len(self.toxic)) + CARRIER, self.ordinary + self.toxic + CARRIER):
            how = zs.ZstdCompressionParameters(
                window_log=log, hash_log=log, chain_log=log, search_log=1, min_match=5, target_length=0, strategy=zs.STRATEGY_DFAST,
                write_content_size=False, write_checksum=False, write_dict_id=False)
            words = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(compression_params=how)
            out.append(zs.ZstdCompressor(dict_data=words, compression_params=how))
        return tuple(out)

    def scores(self, features: np.ndarray) -> np.ndarray:
        x = np.c_[(features - self.mean) / self.spread, np.ones(len(features))]
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -40, 40)))


def features(text: bytes, ordinary, toxic) -> np.ndarray:
    """Windows that save at least so many bytes: per root of the windows, per window, and logarithm."""
    windows = _windows(text.lower())
    if not windows:
        return np.zeros(3 * len(STEPS))
    saved = np.array([len(ordinary(w)) - len(toxic(w)) for w in windows])
    counts = (saved[:, None] >= STEPS).sum(0)
    return np.r_[counts / len(windows) ** 0.5, counts / len(windows), np.log1p(counts)]


def fit(texts: list[bytes], toxic: np.ndarray, prior: float, seed: int = 7) -> Model | None:
    """Dictionaries from one half of the sample, weights of the score from the other; ``prior``: toxic share of all labels."""
    rng = np.random.default_rng(seed)
    half = rng.random(len(texts)) < 0.6
    if min((toxic & half).sum(), (toxic & ~half).sum(), (~toxic & half).sum(), (~toxic & ~half).sum()) < 1:
        return None
    lowered = [t.lower() for t in texts]
    tox = [t for t, y, h in zip(lowered, toxic, half) if y and h]
    ok = [t for t, y, h in zip(lowered, toxic, half) if not y and h]
    in_tox, in_ok = Counter(), Counter()
    for t in tox:
        in_tox.update(_beginnings(t))
    for t in ok:
        in_ok.update(_beginnings(t))
    marks = {g for g, n in in_tox.items()
             if n >= max(2, TOXIC_SHARE * len(tox)) and n / len(tox) > TOXIC_RATIO * (in_ok[g] + 1) / (len(ok) + 1)}
    words: Counter = Counter()
    for t in tox:
        for word in t.split():
            word = b" " + word
            if any(word[:n] in marks for n in range(5, 9)):
                words[word.rstrip(b".,!?;:") + b" "] += 1
    words = Counter({w: n for w, n in words.items() if n >= max(2, WORD_SHARE * len(tox))})
    windows = [t[i:i + 256] for t in ok for i in range(0, len(t), 256)]
    windows = [windows[i] for i in rng.permutation(len(windows))[:30_000]]
    content = b"".join(w for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0])))
    model = Model(_trained(windows, ORDINARY_BYTES), content, None, None, None)
    a, b = (c.compress for c in model.compressors())
    rest = np.flatnonzero(~half)
    x, y = np.array([features(texts[i], a, b) for i in rest]), toxic[rest].astype(float)
    # Weights bring the sample's classes back to their shares among all labels.
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    model.mean, model.spread = x.mean(0), x.std(0) + 1e-9
    x = np.c_[(x - model.mean) / model.spread, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w))
        w += np.linalg.solve(hess, x.T @ (weight * (y - p)) - 0.5 * w)
    model.weights = w
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    """Fit on about ``per_class`` labelled rows of each class outside the held-out fold."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return None
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = F.when(F.col("toxic") == 1, per_class / sizes[1]).otherwise(per_class / sizes[0])
    # The sample's size follows from its share of the labels, so its ids may be broadcast.
    sample = F.broadcast(known.where(place < share * (1 << 30)))
    text = F.coalesce("text", F.lit(""))
    rows = docs.join(sample, "doc_id").where(F.octet_length(text) <= FIT_BYTES).select("doc_id", "toxic", text.alias("text")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.text))
    return fit([r.text.encode() for r in rows], np.array([r.toxic == 1 for r in rows], bool), sizes[1] / (sizes[0] + sizes[1]))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if model.value is None else Model(*model.value)
        if known is not None:
            a, b = (c.compress for c in known.compressors())
        for batch in batches:
            raw, offsets = flat_bytes(batch.column("text"))
            data = raw.tobytes()
            if known is None:
                scores = np.zeros(batch.num_rows)
            elif batch.num_rows:
                scores = known.scores(np.array([features(data[i:j], a, b) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())]))
            else:
                continue
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, "score"])
    return run


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``score``, the calibrated chance that the text is toxic; ``text`` stays."""
    if "score" in docs.columns:
        raise ValueError("docs has a column score already")
    shared = docs.sparkSession.sparkContext.broadcast(
        None if model is None else (model.ordinary, model.toxic, model.mean, model.spread, model.weights))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(released(_score(shared)), f"{shape}, score double")
