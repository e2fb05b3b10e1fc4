"""Best-fit packing of tokenised documents in bulk-synchronous rounds.

Only documents over the capacity are cut; their full pieces are sequences of their own. All other pieces wait, range-sorted
by length, and every sequence begun is a gap. A round range-sorts the gaps, sweeps lengths and gaps from the largest down and
gives each waiting piece its successor, the smallest gap left that holds it; where pieces of one length meet gaps of one width, ranks
decide which goes where. The gaps are updated and the next round begins. As many sequences are begun as the pieces that fit no gap need at least.
While every waiting piece is at most half a gap, the gap takes part as several smaller ones, so short documents do not need one round each.

The sweep itself runs over counts by length and by width, at most ``capacity`` numbers each; pieces and gaps are ranked in their
sorted partitions and look their partner's rank up in the sweep's ranges. No group of equal lengths is ever gathered.

Defined results: a null or empty text is its end id alone; rows that share a doc_id are packed each for itself; further columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from strataframe.llm.hashing import SPACES, Ranges, word_spans
from strataframe.llm.shared import Scratch, flat_bytes, row_chunks

#: Bytes of text encoded in one pass, and distinct pieces of words whose ids a task remembers.
PASS_BYTES = 1 << 20
REMEMBERED = 500_000
#: Ranks within a class stay below this.
RANKS = 1 << 40


LETTER, DIGIT, SIGN = 1, 2, 3


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class of each byte, and bytes of words that are left whole: apostrophes, `<` (it may begin a special token), controls, and all
    letters but the Latin ones from U+00C0 to U+024F.
    """
    kind = np.full(256, SIGN, np.uint8)
    kind[[c for c in range(128) if chr(c).isalpha()] + list(range(0x80, 0xC0)) + list(range(0xC3, 0xCA))] = LETTER
    kind[48:58] = DIGIT
    odd = np.zeros(256, bool)
    odd[[*range(9), *range(14, 32), 39, 60, 127, 0xC0, 0xC1, 0xC2, *range(0xCA, 256)]] = True
    return kind, odd


KIND, ODD = _classes()
#: Two bytes that look like a Latin letter: the multiplication and division signs, and a capital whose small form is two characters.
NO_LETTERS = ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0))
#: New words that are encoded in one text.
TOGETHER = 64


class WordEncoder:
    """Token ids of many texts by a lower-casing tokenizer that drops white space, takes runs of letters and of signs and single digits
    apart, and marks the last token of each.

    A word between blanks is cut there, unless it has one of the bytes of ``ODD``; each distinct piece is encoded once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[int, bytes] = {}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _runs(self, words: list[str]) -> list[bytes]:
        """Ids of runs of letters, many in one text: a run ends where a last token ends."""
        groups = [words[i:i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        out = []
        for group, ids in zip(groups, self._ids([" ".join(g) for g in groups])):
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(group) and ends[-1] == len(ids):
                data = ids.tobytes()
                out += [data[4 * a:4 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
            else:
                out += [i.tobytes() for i in self._ids(group)]
        return out

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Little-endian 32-bit ids of each row."""
        n = len(offsets) - 1
        starts, ends, _ = word_spans(raw, offsets)
        if not len(starts):
            return [b""] * n
        odd = ODD[raw]
        for lead, low in NO_LETTERS:
            odd[:-1] |= (raw[:-1] == lead) & (raw[1:] == low)
        whole = np.zeros(len(starts), bool)
        whole[np.searchsorted(starts, np.flatnonzero(odd & ~SPACES[raw]), "right") - 1] = True
        step = np.zeros(len(raw) + 1, np.int8)
        step[starts[whole]] += 1
        step[ends[whole]] -= 1
        cut = np.cumsum(step[:-1], dtype=np.int8) == 0
        # Latin capitals are read as small letters, but not in whole words.
        raw = np.where(cut & (raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
        kind = KIND[raw]
        begin = np.zeros(len(raw), bool)
        begin[1:] = cut[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)) & ~SPACES[raw[1:]]
        begin[starts] = True
        heads = np.flatnonzero(begin)
        tails = np.minimum(np.r_[heads[1:], len(raw)], ends[np.searchsorted(starts, heads, "right") - 1])
        keys, example, where = np.unique(Ranges(raw).of(heads, tails), return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, names, data = self.known, keys.tolist(), raw.tobytes()
        missing = np.array([i for i, k in enumerate(names) if k not in known], np.int64)
        at = example[missing]
        letters = (kind[heads[at]] == LETTER) & cut[heads[at]]
        for chosen, encode in ((missing[letters], self._runs), (missing[~letters], lambda w: [i.tobytes() for i in self._ids(w)])):
            first = example[chosen]
            words = [data[a:b].decode() for a, b in zip(heads[first].tolist(), tails[first].tolist())]
            known.update(zip(keys[chosen].tolist(), encode(words)))
        parts = [known[k] for k in names]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) >> 2
        flat = np.frombuffer(b"".join(parts), np.uint32)
        place, count = np.cumsum(sizes) - sizes, sizes[where]
        total = np.r_[0, np.cumsum(count)]
        ids = flat[np.repeat(place[where] - total[:-1], count) + np.arange(total[-1])].tobytes()
        bounds = (4 * total[np.searchsorted(heads, offsets)]).tolist()
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


PIECES = "item long, doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, capacity: int, end_id: int):
    tail = np.array([end_id], np.uint32).tobytes()
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordEncoder(path)
        task = TaskContext.get()
        item = (task.partitionId() if task else 0) << 33
        for batch in batches:
            raw, offsets = flat_bytes(batch.column("text"))
            docs = batch.column("doc_id").to_pylist()
            for lo, hi in row_chunks(offsets, PASS_BYTES):
                out = []
                for k, ids in zip(range(lo, hi), encode(raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])):
                    ids += tail
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at:at + 4 * capacity]
                        out.append((item, docs[k], piece, at >> 2, len(part) >> 2, zlib.crc32(part)))
                        item += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[f.split()[0] for f in PIECES.split(", ")])
    return run


def _numbered(key: str):
    """Adds ``part`` and ``local``, the number of the row among its part's rows of one ``key``; the rows come sorted by it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part = task.partitionId() if task else 0
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            value = batch.column(key).to_numpy()
            heads = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
            local = np.arange(len(value)) - np.repeat(heads, np.diff(np.r_[heads, len(value)]))
            if value[0] == last:
                local[:heads[1] if len(heads) > 1 else len(value)] += seen
            last, seen = value[-1], int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(value), part, np.int64)), pa.array(local)],
                                             names=[*batch.schema.names, "part", "local"])
    return run


class Ranked:
    """Rows range-sorted by ``key``, with their place among the rows of one key: ``counts`` per key and the offset of each part."""

    def __init__(self, df: DataFrame, key: str, ties: list[str], scratch: Scratch, name: str):
        shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
        placed = df.repartitionByRange(key, *ties).sortWithinPartitions(key, *ties).mapInArrow(_numbered(key), f"{shape}, part long, local long")
        self.rows = scratch.write(placed, name)
        # A range partition holds a run of keys, so there are fewer rows than partitions and keys together.
        found = self.rows.groupBy(key, "part").count().collect()
        found = sorted((r[0], r[1], r[2]) for r in found)
        self.counts: dict[int, int] = {}
        at, offset = [], []
        for value, part, count in found:
            at.append((part << 16) + value)
            offset.append(self.counts.get(value, 0))
            self.counts[value] = self.counts.get(value, 0) + count
        order = np.argsort(np.array(at, np.int64))
        self.at, self.offset = np.array(at, np.int64)[order], np.array(offset, np.int64)[order]

    def rank(self, key: str):
        """Rank among all rows of one key, of the rows of a batch."""
        at, offset = self.at, self.offset
        return lambda batch: offset[np.searchsorted(at, (batch.column("part").to_numpy() << 16) + batch.column(key).to_numpy())] + batch.column("local").to_numpy()


def sweep(waiting: dict[int, int], taken: dict[int, int], gaps: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """Best fit by counts, from the largest down: rows (width, first gap rank, one past the last, length, first piece rank).

    ``waiting`` pieces by length, of which the first ``taken`` ranks are gone; ``gaps`` by width. The smallest gaps that hold a length are on top of the stack.
    """
    out, stack = [], []
    widths = sorted(gaps, reverse=True)
    w = 0
    for length in sorted(waiting, reverse=True):
        while w < len(widths) and widths[w] >= length:
            stack.append([widths[w], 0, gaps[widths[w]]])
            w += 1
        left, rank = waiting[length], taken.get(length, 0)
        while left and stack:
            width, first, past = stack[-1]
            n = min(left, past - first)
            out.append((width, first, first + n, length, rank))
            left, rank = left - n, rank + n
            stack[-1][1] += n
            if first + n == past:
                stack.pop()
    return out


def _matched(ranges: list[tuple[int, int, int, int, int]], rank):
    """Slots (bin, slot, gap) with the length and rank of the piece each takes; length 0 for none."""
    width, first, past, length, start = (np.array(c, np.int64) for c in zip(*sorted(ranges)))
    keys = width * RANKS + first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = rank(batch)
            k = np.searchsorted(keys, batch.column("width").to_numpy() * RANKS + mine, "right") - 1
            hit = (k >= 0) & (width[k] == batch.column("width").to_numpy()) & (mine < past[k])
            yield pa.RecordBatch.from_arrays(
                [batch.column("bin"), batch.column("slot"), batch.column("gap"), pa.array(np.where(hit, length[k], 0)), pa.array(np.where(hit, start[k] + mine - first[k], -1))],
                names=["bin", "slot", "gap", "length", "rank"])
    return run


def best_fit(items: DataFrame, scratch: Scratch, capacity: int) -> DataFrame:
    """``item``, ``bin``, ``offset`` of every row of ``items`` (item, length from 1 to ``capacity``)."""
    spark = items.sparkSession
    ranked = Ranked(items.select("item", "length"), "length", ["item"], scratch, "lengths")
    waiting, taken = dict(ranked.counts), {}
    gaps, widest, bins, rounds = None, 0, 0, []
    while waiting:
        # What fits no gap needs new sequences, by its total at least.
        homeless = sum(s * n for s, n in waiting.items() if s > widest)
        more = -(-homeless // capacity)
        if more:
            fresh = spark.range(bins, bins + more).select(F.col("id").alias("bin"), F.lit(capacity).cast("long").alias("gap"))
            gaps, bins = fresh if gaps is None else gaps.unionByName(fresh), bins + more
        longest = max(waiting)
        slots = F.greatest(F.lit(1), F.least(F.floor(F.col("gap") / longest), F.lit(-(-2 * sum(waiting.values()) // bins)))).cast("long")
        dealt = gaps.withColumn("slots", slots).select(
            "bin", "gap", F.floor(F.col("gap") / F.col("slots")).cast("long").alias("width"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("slots"))).alias("slot"))
        sorted_slots = Ranked(dealt, "width", ["bin", "slot"], scratch, "gaps")
        ranges = sweep(waiting, taken, sorted_slots.counts)
        matched = sorted_slots.rows.mapInArrow(_matched(ranges, sorted_slots.rank("width")), "bin long, slot long, gap long, length long, rank long")
        matched = scratch.write(matched, "round")
        rounds.append(matched.where("length > 0").select("bin", F.lit(len(rounds)).alias("round"), "slot", "length", "rank"))
        for _, first, past, length, _ in ranges:
            taken[length] = taken.get(length, 0) + past - first
            waiting[length] -= past - first
            if not waiting[length]:
                del waiting[length]
        if waiting:
            gaps = matched.groupBy("bin").agg((F.first("gap") - F.sum("length")).alias("gap")).where(F.col("gap") >= min(waiting))
            # One scalar; a width no piece can have means none is left.
            widest = gaps.agg(F.max("gap")).first()[0] or 0
    if not rounds:
        return items.select("item", F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("offset")).where("false")
    placed = rounds[0]
    for r in rounds[1:]:
        placed = placed.unionByName(r)
    # A bin holds at most ``capacity`` pieces.
    before = Window.partitionBy("bin").orderBy("round", "slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    rank = ranked.rank("length")

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("length"), pa.array(rank(batch))], names=["item", "length", "rank"])

    return ranked.rows.mapInArrow(ranks, "item long, length long, rank long").join(placed, ["length", "rank"]).select("item", "bin", "offset")


def pack_best_fit(docs: DataFrame, tokenizer: str, scratch: Scratch, *, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pieces of the token ids of ``docs`` (doc_id, text), each with its place in a sequence.

    ``tokenizer`` is a file of the tokenizers library that drops white space between words and that every executor can open. A document is
    its ids and ``end_id``. Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    pieces = scratch.write(docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, capacity, end_id), PIECES), "pieces")
    packed = best_fit(pieces.where(F.col("length") < capacity).select("item", "length"), scratch, capacity)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = pieces.where(F.col("length") == capacity).select(*columns, (F.col("item") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.join(packed, "item").select(*columns, (F.col("bin") * 2).alias("sequence_id"), "offset")
    return full.unionByName(rest)
