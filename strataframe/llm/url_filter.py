"""URL filter: host and path rules, and a character language-model ratio where no rule applies.

Two variable-order Markov models, of accepted and of rejected URLs, are counted over all URLs that a rule decides and
that are not held out. Orders up to ``ORDER`` are interpolated (Witten-Bell): how much a longer context counts depends on how
often it was seen and how many characters followed it. Characters fall into ``SYMBOLS`` symbols, so the counts have a fixed
largest size whatever the input. A URL is blocked when its log-likelihood difference per character, rejected minus accepted, is over
a threshold calibrated on the held-out fold of decided URLs: the least one that blocks at most ``FALSE_BLOCK`` of the
accepted ones.

Defined results: a null URL, or one without ``://``, has an empty host and path, meets no rule and is judged by the method; an empty
URL has the difference 0; without decided URLs of both kinds the method allows everything; rows that repeat are judged alike; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strataframe.llm.shared import flat_bytes, row_chunks

#: Symbols: end of URL, 26 letters, digit, nine signs, anything else.
SIGNS = "/.-_?=&#%:"
SYMBOLS = 2 + 26 + 1 + len(SIGNS)
ORDER = 3
FALSE_BLOCK = 0.02
#: Bins of the held-out differences from which the threshold is read.
BINS, REACH = 4000, 4.0


def host_of(url: Column) -> Column:
    """After the first ``://`` up to a slash, question mark, number sign or the end; A-Z lower-cased."""
    host = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to a question mark, number sign or the end."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest of ``rules`` (verdict, ``host/path``) that fits: its host or a subdomain of it, and a path that starts with its path."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _symbols() -> np.ndarray:
    out = np.full(256, SYMBOLS - 1, np.int64)
    for i in range(26):
        out[97 + i] = out[65 + i] = 1 + i
    out[48:58] = 27
    for i, c in enumerate(SIGNS):
        out[ord(c)] = 28 + i
    return out


CODES = _symbols()


def _contexts(raw: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Codes of the symbols with 0 to ORDER symbols before them, an end symbol after each row, and the row of each."""
    n = len(offsets) - 1
    sizes = np.diff(offsets) + 1
    ends = np.cumsum(sizes)
    flat = np.zeros(int(ends[-1]) if n else 0, np.int64)
    inside = np.ones(len(flat), bool)
    inside[ends - 1] = False
    flat[inside] = CODES[raw]
    row = np.repeat(np.arange(n), sizes)
    place = np.arange(len(flat)) - np.repeat(ends - sizes, sizes)
    out, code = [flat], flat
    for k in range(1, ORDER + 1):
        before = np.zeros(len(flat), np.int64)
        before[k:] = flat[:-k]
        before[place < k] = 0
        code = code + before * SYMBOLS ** k
        out.append(code)
    return out, row


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the longest codes by kind of URL, summed over the task."""
    total = [np.zeros(SYMBOLS ** (ORDER + 1), np.int64) for _ in range(2)]
    for batch in batches:
        bad = batch.column("bad").to_numpy(zero_copy_only=False)
        raw, offsets = flat_bytes(batch.column("url"))
        for lo, hi in row_chunks(offsets):
            codes, row = _contexts(raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
            kind = bad[lo:hi][row]
            for k in range(2):
                np.add.at(total[k], codes[ORDER][kind == k], 1)
    for k in range(2):
        used = np.flatnonzero(total[k])
        if len(used):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), k, np.int32)), pa.array(used), pa.array(total[k][used])], names=["kind", "code", "n"])


class MarkovModel:
    """Interpolated models of one kind of URL, as log probabilities of the longest codes."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        full = np.zeros(SYMBOLS ** (ORDER + 1))
        full[codes] = counts
        probability = np.full(1, 1 / SYMBOLS)
        for k in range(ORDER + 1):
            # Codes with k symbols before: the rest, higher symbols, is summed out.
            seen = full.reshape(-1, SYMBOLS ** (k + 1)).sum(0).reshape(-1, SYMBOLS)
            held, kinds = seen.sum(1, keepdims=True), (seen > 0).sum(1, keepdims=True)
            below = np.broadcast_to(probability.reshape(-1, 1 if k == 0 else SYMBOLS), (SYMBOLS ** max(0, k - 1), 1 if k == 0 else SYMBOLS))
            below = np.tile(below, (seen.shape[0] // below.shape[0], 1))
            with np.errstate(invalid="ignore"):
                probability = np.where(held > 0, (seen + kinds * below) / np.maximum(held + kinds, 1), below).reshape(-1)
        self.logs = np.log(probability).astype(np.float32)


def differences(raw: np.ndarray, offsets: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Mean log ratio of the characters of each row."""
    codes, row = _contexts(raw, offsets)
    sizes = np.diff(offsets) + 1
    return np.bincount(row, ratio[codes[ORDER]], len(sizes)) / sizes * (sizes > 1)


def _score(ratio):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ratio.value
        for batch in batches:
            raw, offsets = flat_bytes(batch.column("url"))
            if table is None:
                scores = np.zeros(batch.num_rows)
            else:
                scores = np.concatenate([np.zeros(0), *(
                    differences(raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], table) for lo, hi in row_chunks(offsets))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, "difference"])
    return run


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], *, false_block: float = FALSE_BLOCK) -> DataFrame:
    """Per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict (allow or block), difference."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("rule", F.col("found.rule")).withColumn("ruled", F.col("found.verdict")).drop("found")
    fold = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
    decided = rows.where("ruled is not null and url is not null").select("url", F.when(F.col("ruled") == "block", 1).otherwise(0).alias("bad"), fold.alias("held"))
    counts = decided.where("not held").mapInArrow(_count, "kind int, code long, n long").groupBy("kind", "code").agg(F.sum("n").alias("n")).toArrow()
    kind, code, n = (counts.column(c).to_numpy() for c in ("kind", "code", "n"))
    context = pages.sparkSession.sparkContext
    both = len(np.unique(kind)) == 2
    ratio = (MarkovModel(code[kind == 1], n[kind == 1]).logs - MarkovModel(code[kind == 0], n[kind == 0]).logs) if both else None
    shared = context.broadcast(ratio)
    threshold = float("inf")
    if both:
        # A histogram of fixed size gives the threshold.
        held = decided.where("held and bad = 0").mapInArrow(_score(shared), "url string, bad int, held boolean, difference double")
        step = 2 * REACH / BINS
        bins = held.groupBy(F.floor(F.greatest(F.lit(-REACH), F.least(F.lit(REACH), "difference")) / step).alias("bin")).agg(F.count("*").alias("n")).collect()
        total = above = sum(r.n for r in bins)
        for r in sorted(bins, key=lambda r: r.bin):
            above -= r.n
            if above <= false_block * total:
                threshold = (r.bin + 1) * step
                break
        threshold = max(threshold, 0.0)
    scored = rows.mapInArrow(_score(shared), "page_id long, url string, host string, path string, rule string, ruled string, difference double")
    method = F.when(F.col("difference") > threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "difference")
