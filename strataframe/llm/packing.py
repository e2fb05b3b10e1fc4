"""Packing of tokenised documents into windows of near-equal length.

Karmarkar-Karp multiway differencing: every piece starts as a partial partition of its own;
the two partial partitions with the widest imbalance are merged so that heavy windows meet light
ones, until one partition is left. When a window then exceeds the capacity, the number of windows rises and
the group is packed again. Groups are bounded (``GROUP_WINDOWS`` windows), and each task packs what it reads: no shuffle.

Defined results: a null or empty text is its end id alone; a long document fills whole windows first; rows with the same
doc_id are packed each for itself; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from strataframe.llm.hashing import Ranges
from strataframe.llm.shared import flat_bytes, released, row_chunks

#: Windows of one differencing group, and the part of their capacity that is filled.
GROUP_WINDOWS = 64
FILL = 0.992
#: What is left of a document after its whole windows is cut into pieces of this length.
PIECE = 256
#: Word pieces whose ids a task remembers.
REMEMBERED = 500_000
#: Word pieces that are encoded in one text.
TOGETHER = 256

SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class of each byte, and bytes whose texts are left to the tokenizer's own splitting."""
    kind = np.full(256, OTHER, np.uint8)
    for c in range(128):
        ch = chr(c)
        kind[c] = LETTER if ch.isalpha() else DIGIT if ch.isdigit() else OTHER
    kind[[9, 10, 13, 32]] = SPACE
    kind[0xC3:0xCA] = kind[0x80:0xC0] = LETTER
    odd = np.zeros(256, bool)
    odd[[c for c in range(32) if c not in (9, 10, 13)] + [39, 127]] = True
    odd[0xC0:0xC3] = odd[0xCA:] = True
    return kind, odd


KIND, ODD = _classes()


class Encoder:
    """Token ids of many texts. Each distinct word piece is encoded once, by the tokenizer."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[int, bytes] = {}
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        #: The id that parts pieces encoded in one text, if a line end is one id.
        self.line = line[0] if len(line) == 1 else None

    def _texts(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _pieces(self, words: list[str]) -> list[bytes]:
        """Ids of word pieces, ``TOGETHER`` of them as the lines of one text: a line end is always a piece of its own.

        Pieces of white space would join the line ends; they are encoded alone, as is a text with other line ends than were put in.
        """
        plain = [i for i, w in enumerate(words) if self.line is not None and w.lstrip(" ") and not w.startswith("  ") and w[-1] not in "\t\n\r "]
        out: list[bytes] = [b""] * len(words)
        alone = set(range(len(words))).difference(plain)
        groups = [plain[i:i + TOGETHER] for i in range(0, len(plain), TOGETHER)]
        texts = ["\n".join(["", *[words[i] for i in g], ""]) for g in groups]
        for group, packed in zip(groups, self._texts(texts)):
            ends = np.flatnonzero(np.frombuffer(packed, np.uint32) == self.line) * 4
            if len(ends) != len(group) + 1 or ends[0] != 0 or ends[-1] + 4 != len(packed):
                alone.update(group)
                continue
            bounds = ends.tolist()
            for i, a, b in zip(group, bounds, bounds[1:]):
                out[i] = packed[a + 4:b]
        rest = sorted(alone)
        for i, ids in zip(rest, self._texts([words[i] for i in rest])):
            out[i] = ids
        return out

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Little-endian 32-bit ids of each row."""
        n = len(offsets) - 1
        data = raw.tobytes()
        own = np.zeros(n, bool)
        rows_of = lambda at: np.searchsorted(offsets, at, "right") - 1
        own[rows_of(np.flatnonzero(ODD[raw]))] = True
        # The multiplication and division signs are the two non-letters among the Latin letters.
        signs = np.flatnonzero((raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))) if len(raw) else np.zeros(0, int)
        own[rows_of(signs)] = True
        for s in self.special:
            at = data.find(s)
            while at >= 0:
                own[rows_of(np.array([at]))] = True
                at = data.find(s, at + 1)
        out: list[bytes] = [b""] * n
        mine = np.flatnonzero(own)
        for k, ids in zip(mine.tolist(), self._texts([data[offsets[k]:offsets[k + 1]].decode() for k in mine])):
            out[k] = ids
        starts = piece_starts(raw, offsets)
        if not len(starts):
            return out
        ends = np.r_[starts[1:], len(raw)]
        keys, first, where = np.unique(Ranges(raw).of(starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, names = self.known, keys.tolist()
        used = np.zeros(len(keys), bool)
        used[where[~own[rows_of(starts)]]] = True
        missing = [i for i in np.flatnonzero(used).tolist() if names[i] not in known]
        if missing:
            words = [data[starts[first[i]]:ends[first[i]]].decode() for i in missing]
            for i, ids in zip(missing, self._pieces(words)):
                known[names[i]] = ids
        parts = [known.get(k, b"") for k in names]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) >> 2
        flat = np.frombuffer(b"".join(parts), np.uint32)
        begin = np.cumsum(sizes) - sizes
        count = sizes[where]
        total = np.r_[0, np.cumsum(count)]
        ids = flat[np.repeat(begin[where] - total[:-1], count) + np.arange(total[-1])]
        bounds = total[np.searchsorted(starts, offsets)].tolist()
        packed = ids.tobytes()
        for k in np.flatnonzero(~own).tolist():
            out[k] = packed[4 * bounds[k]:4 * bounds[k + 1]]
        return out


def piece_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the word pieces of byte-level BPE: runs of letters, digits or signs, each with one space before it,
    and what else there is of white space. Right for rows without apostrophes and bytes of ``ODD``.
    """
    if not len(raw):
        return np.zeros(0, np.int64)
    kind = KIND[raw]
    row_edge = np.zeros(len(raw) + 1, bool)
    row_edge[offsets] = True
    turn = np.ones(len(raw), bool)
    turn[1:] = kind[1:] != kind[:-1]
    turn |= row_edge[:-1]
    space = kind == SPACE
    begin = turn & space
    # The last white space of a run before something else stands alone or, if it is a space, with what follows.
    last = np.zeros(len(raw), bool)
    last[:-1] = space[:-1] & ~space[1:] & ~row_edge[1:-1]
    joined = np.zeros(len(raw), bool)
    joined[1:] = last[:-1] & (raw[:-1] == 32)
    return np.flatnonzero(begin | last | (turn & ~space & ~joined))


def differencing(sizes: list[int], windows: int) -> list[tuple[int, list[int]]]:
    """Windows (sum, piece numbers) of near-equal sums by multiway differencing; empty windows are left out."""
    heap = []
    for i, size in enumerate(sizes):
        heap.append((-size, i, [(size, [i])]))
    heapq.heapify(heap)
    count = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # Both are sorted with the heaviest first and lack their empty windows, which meet the other's heaviest.
        over = len(a) + len(b) - windows
        if over <= 0:
            merged = a + b
        else:
            free_a, free_b = len(a) - over, len(b) - over
            merged = a[:free_a] + b[:free_b]
            merged += [(x + y, p + q) for (x, p), (y, q) in zip(a[free_a:], reversed(b[free_b:]))]
        merged.sort(key=lambda w: -w[0])
        least = merged[-1][0] if len(merged) == windows else 0
        heapq.heappush(heap, (least - merged[0][0], count, merged))
        count += 1
    return heap[0][2] if heap else []


def packed_group(sizes: list[int], capacity: int) -> list[list[int]]:
    """Piece numbers of each window, none over the capacity."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        found = differencing(sizes, windows)
        if not found or found[0][0] <= capacity:
            return [p for _, p in found]
        windows += 1


def _pack(path: str, capacity: int, end_id: int):
    tail = np.array([end_id], np.uint32).tobytes()
    full = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 40
        group: list[tuple] = []
        held = 0
        out: list[tuple] = []

        def close() -> None:
            nonlocal number, held
            for window in packed_group([p[2] for p in group], capacity):
                at = 0
                for k in sorted(window):
                    out.append((*group[k], number, at))
                    at += group[k][2]
                number += 1
            group.clear()
            held = 0

        def rows() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            raw, offsets = flat_bytes(batch.column("text"))
            docs = batch.column("doc_id").to_pylist()
            for lo, hi in row_chunks(offsets):
                for k, ids in zip(range(lo, hi), encode(raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])):
                    ids += tail
                    n = len(ids) >> 2
                    at = 0
                    while n - at >= capacity:
                        out.append((docs[k], at, capacity, zlib.crc32(ids[4 * at:4 * at + full]), n, number, 0))
                        number += 1
                        at += capacity
                    while at < n:
                        size = min(PIECE, n - at)
                        room = int(GROUP_WINDOWS * capacity * FILL) - held
                        size = min(size, max(1, room))
                        group.append((docs[k], at, size, zlib.crc32(ids[4 * at:4 * (at + size)]), n))
                        at += size
                        held += size
                        if held >= int(GROUP_WINDOWS * capacity * FILL):
                            close()
                if len(out) > 20_000:
                    yield rows()
        if group:
            close()
        if out:
            yield rows()
    return run


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of the token ids of ``docs`` (doc_id, text), each with its place in a sequence.

    ``tokenizer`` is a file of the tokenizers library that every executor can open. A document is its ids and
    ``end_id``. Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    """
    return docs.select("doc_id", "text").mapInArrow(
        released(_pack(tokenizer, capacity, end_id)),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
