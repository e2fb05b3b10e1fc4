"""Word-shingle Jaccard self-join that returns classes of linked documents.

Token-combination prefixes. Shingles are ordered rare first, by a fixed-size count of all
shingles. A document whose prefix holds only rare shingles is indexed by those, one by one.
A document with fewer rare shingles extends its prefix over all its frequent ones; these are
dealt into classes by hash, and the combination of all frequent shingles of one class is one
key. Two sets that reach the threshold share a rare shingle of their prefixes or, by the
pigeonhole principle, all shingles of one class, since there are more classes than shingles
that may differ. There are more classes than needed, and the most common ones are no keys.

Keys only propose pairs. A pair whose parity bitmaps differ in more bits than shingles may
differ goes; what is left is joined to clusters, and every link is verified on whole shingle
sets. Pairs without a link do not join clusters, so these do not grow with the table.

Defined results: a null, empty or blank text has ``n_shingles`` 0 and is linked with nothing;
equal sets are one class; rows that repeat a ``doc_id`` are one document; a null ``doc_id`` takes part, and a
class made of such rows only has a null ``component_id``; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strataframe.llm.components import components
from strataframe.llm.hashing import U, mix, shingle_sets
from strataframe.llm.shared import Scratch, column, flat_bytes, gathered, released, row_chunks

#: Slots of the shingle count, whatever the input (8 MB), sent in parts; a slot counts no further than this.
SLOT_BITS = 22
SKETCH_PARTS = 16
MOST_COUNT = (1 << 16) - 1
#: A shingle is rare when its slot counts no more than this.
RARE_COUNT = 2
#: Sizes of one level differ by this factor at most; the fewer levels, the fewer sets have keys of two.
LEVEL_RATIO = 2
#: Classes of a level for each that its largest sets have a key of.
SPARE_RATIO = 1.5
#: Index rows a task gathers before it hands them on.
INDEX_ROWS = 1 << 20
#: Sets of a key that meet pair by pair; more are a crowd, which meets in blocks.
PAIRED = 16
#: Documents of a cluster or crowd that meet in one task.
BLOCK = 1024
#: Slots of the marks of wanted documents (2 MB), as a power of two.
WANTED_BITS = 24
#: Bits of a parity bitmap, as powers of two.
MAP_BITS = 9, 14


class Levels:
    """Size levels of shingle sets and the number of classes of each, for a threshold in percent."""

    def __init__(self, percent: int):
        if not 50 < percent <= 100:
            raise ValueError("percent must be over 50 and at most 100")
        self.percent = percent
        # Smaller sets reach the threshold with equal sets only.
        self.first = -(-(100 + percent) // max(1, 100 - percent)) // 2 if percent < 100 else 1 << 62
        self.ratio = max(LEVEL_RATIO, 102 / percent)

    def differing(self, both: int) -> int:
        """Most shingles in which two linked sets differ whose sizes sum up to ``both``."""
        return (100 - self.percent) * both // (100 + self.percent)

    def bounds(self, level: int) -> tuple[int, int]:
        lo = self.first
        for _ in range(level):
            lo = math.ceil(lo * self.ratio)
        return lo, math.ceil(lo * self.ratio)

    def of(self, n: int) -> list[int]:
        """The level of a size, and the next one if a linked set may lie there."""
        level, (lo, hi) = 0, self.bounds(0)
        while n >= hi:
            level, lo, hi = level + 1, hi, math.ceil(hi * self.ratio)
        return [level, level + 1] if self.percent * hi <= 100 * n else [level]

    def classes(self, level: int) -> tuple[int, int]:
        """Number of classes, and how many of them even the largest sets leave out: empty and common ones."""
        most = self.differing(2 * (self.bounds(level)[1] - 1)) + 1
        spare = math.ceil((SPARE_RATIO - 1) * most)
        return most + spare, spare

    def reach(self, n: int, level: int) -> int:
        """Most shingles in which a set of ``n`` differs from a set that it is linked with and meets at ``level``."""
        return self.differing(n + min(self.bounds(level)[1] - 1, 100 * n // self.percent))

    def prefix(self, n: int) -> int:
        return n - -(-self.percent * n // 100) + 1


def _set_keys(tokens: np.ndarray, counts: np.ndarray, levels: Levels, plans: dict) -> list[tuple[int, np.ndarray]]:
    """Index keys of one shingle set (sorted hashes) by size level; ``counts`` has the slot count of each shingle.

    A linked set shares a rare shingle, or differs in all rare ones of either: then ``len(few)`` fewer of the classes may
    differ. With all classes in one order, each set may leave out the most common as far as the others must hold a shared one.
    """
    n = len(tokens)
    rare = counts <= RARE_COUNT
    few, prefix = tokens[rare], levels.prefix(n)
    if n not in plans:
        plans[n] = [(level, levels.classes(level)[0], levels.reach(n, level)) for level in levels.of(n)]
    out = []
    for level, count, reach in plans[n]:
        keys = [mix(few[:prefix] ^ U(0x5851F42D4C957F2D + level))]
        if len(few) < prefix:
            many = tokens[~rare]
            salted = mix(many ^ U(0xD1B54A32D192ED03 + level))
            of = (salted % U(count)).astype(np.int64)
            low = np.bincount(of, (salted >> U(8) & U(0xFFFFFF)).astype(float), count)
            high = np.bincount(of, (salted >> U(32)).astype(float), count)
            size = np.bincount(of, minlength=count)
            key = mix(mix(low.astype(U) * U(0x2545F4914F6CDD1D) + high.astype(U)) + size.astype(U) * U(0x9E3779B97F4A7C15)
                      + np.arange(count, dtype=U) * U(0xA0761D6478BD642F) + U(level))
            # A combination is as common as its rarest shingle at most; empty classes are the most common.
            common = np.full(count, MOST_COUNT + 1, U)
            np.minimum.at(common, of, counts[~rare].astype(U))
            order = common << U(40) | key >> U(24)
            keep = reach - len(few) + 1
            keys.append(key[order <= np.partition(order, keep - 1)[keep - 1]] if keep < count else key)
        out.append((level, np.concatenate(keys).view(np.int64)))
    return out


def _node(name: bytes) -> int:
    """A set in the index; equal numbers of other sets only propose more."""
    return int.from_bytes(name[:8], "big", signed=True)


def parity(tokens: np.ndarray) -> bytes:
    """For each slot whether it holds an odd number of shingles: two sets differ in as many shingles as bits, at least."""
    bits = 1 << max(MAP_BITS[0], min(MAP_BITS[1], (2 * len(tokens)).bit_length()))
    return np.packbits((np.bincount((tokens & U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(maps: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (a row each) as sets of fewer slots have them, ``size`` bytes long."""
    while maps.shape[1] > size:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a.view(U) ^ b.view(U)).sum(1, dtype=np.int64)


def _scan(width: int, levels: Levels):
    """Per document its set's size, fingerprint and bitmap; per task the counts of its shingles by slot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SLOT_BITS, np.uint32)
        for batch in batches:
            raw, offsets = flat_bytes(batch.column("text"))
            sizes, prints, maps = [], [], []
            for lo, hi in row_chunks(offsets):
                part = slice(offsets[lo], offsets[hi])
                sets = shingle_sets(raw[part], offsets[lo:hi + 1] - offsets[lo], width)
                slots = (np.concatenate(sets) >> U(64 - SLOT_BITS)).astype(np.int64)
                if len(slots) > 1 << 16:
                    counts += np.bincount(slots, minlength=len(counts)).astype(np.uint32)
                else:
                    np.add.at(counts, slots, np.uint32(1))
                sizes += [len(s) for s in sets]
                prints += [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                maps += [parity(s) if len(s) >= levels.first else None for s in sets]
            n = len(sizes)
            if n:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()),
                     pa.array([_node(p) for p in prints], pa.int64()), pa.array(maps, pa.binary()),
                     pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                    names=["doc_id", "n_shingles", "print", "node", "map", "part", "counts"])
        # Low bytes, then high bytes, which are nearly all zero.
        parts = np.minimum(counts, MOST_COUNT).astype("<u2").view(np.uint8).reshape(SKETCH_PARTS, -1, 2).transpose(0, 2, 1)
        if counts.any():
            k = SKETCH_PARTS
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()),
                 pa.array(range(k), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())],
                names=["doc_id", "n_shingles", "print", "node", "map", "part", "counts"])
    return run


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, payload in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
            counts = np.frombuffer(zlib.decompress(payload), np.uint8).reshape(2, -1).T.copy().view("<u2")[:, 0].astype(np.uint32)
            total[part] = np.minimum(total[part] + counts, MOST_COUNT) if part in total else counts
    if total:
        sums = [c.astype("<u2").tobytes() for c in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(sums, pa.binary())], names=["part", "counts"])


def _index(width: int, levels: Levels, slot_counts):
    """Index rows (key, node) of every distinct set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(slot_counts.value, "<u2")
        keys: list[np.ndarray] = []
        nodes: list[np.ndarray] = []
        seen: set[bytes] = set()
        plans: dict = {}
        held = 0
        for batch in batches:
            raw, offsets = flat_bytes(batch.column("text"))
            for lo, hi in row_chunks(offsets):
                for s in shingle_sets(raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], width):
                    if len(s) < levels.first:
                        continue
                    name = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    if name in seen:
                        continue
                    seen.add(name)
                    for _, found in _set_keys(s, counts[(s >> U(64 - SLOT_BITS)).astype(np.int64)], levels, plans):
                        keys.append(found)
                        nodes.append(np.full(len(found), _node(name)))
                        held += len(found)
                if held > INDEX_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(nodes))], names=["key", "node"])
                    keys, nodes, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(nodes))], names=["key", "node"])
    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of the sets of each key; of a crowd its first set with each other, marked as ``crowd``."""
    rows = gathered(batches)
    if rows is None:
        return
    key, node = column(rows, "key"), column(rows, "node")
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
    key, node = key[new], node[new]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)])
    end, size, lead = np.repeat(first + size, size), np.repeat(size, size), np.repeat(first, size)
    at = np.flatnonzero((size > 1) & (size <= PAIRED))
    lo, hi = [], []
    for step in range(1, PAIRED):
        at = at[at + step < end[at]]
        lo.append(at)
        hi.append(at + step)
    at = np.flatnonzero((size > PAIRED) & (lead < np.arange(len(key))))
    for lo, hi, crowd in ((np.concatenate(lo), np.concatenate(hi), False), (lead[at], at, True)):
        a, b = node[lo], node[hi]
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new]), pa.array(np.full(int(new.sum()), crowd))], names=["a", "b", "crowd"])


def _stacked(maps: pa.Array) -> np.ndarray:
    raw, offsets = flat_bytes(maps)
    return raw.reshape(len(maps), -1) if len(maps) else np.zeros((0, 8), np.uint8)


def _sift(percent: int):
    """Of pairs of sets those whose bitmaps allow a link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.diff(flat_bytes(batch.column(c))[1]) for c in ("x_map", "y_map"))
            both = column(batch, "x_size") + column(batch, "y_size")
            fits = np.zeros(len(both), bool)
            for u, v in np.unique(np.stack([x, y], 1), axis=0).tolist():
                at = np.flatnonzero((x == u) & (y == v))
                one, other = (folded(_stacked(batch.column(c).take(pa.array(at))), min(u, v)) for c in ("x_map", "y_map"))
                fits[at] = _apart(np.ascontiguousarray(one), np.ascontiguousarray(other)) * (100 + percent) <= (100 - percent) * both[at]
            less, more = np.minimum(column(batch, "x_size"), column(batch, "y_size")), np.maximum(column(batch, "x_size"), column(batch, "y_size"))
            fits &= 100 * less >= percent * more
            if fits.any():
                kept = pa.array(fits)
                yield pa.RecordBatch.from_arrays([batch.column("x").filter(kept), batch.column("y").filter(kept)], names=["a", "b"])
    return run


def allowed_pairs(sizes: np.ndarray, maps: list[bytes], blocks: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs that join all sets of one or two blocks whose bitmaps allow a link; pairs already joined are not looked at again."""
    order = np.argsort(sizes, kind="stable")
    sizes, blocks, length = sizes[order], blocks[order], np.array([len(maps[i]) for i in order])
    two = len(np.unique(blocks)) > 1
    labels = np.arange(len(sizes))
    out = []
    for own in np.unique(length).tolist():
        # Linked sets are at most twice as large, so their bitmaps have this length or twice it.
        first, stop, last = np.searchsorted(length, own), np.searchsorted(length, own, "right"), np.searchsorted(length, 2 * own, "right")
        rows = [np.frombuffer(b"".join(maps[i] for i in order[lo:hi]), np.uint8).reshape(hi - lo, -1) for lo, hi in ((first, stop), (stop, last)) if hi > lo]
        near = np.ascontiguousarray(np.concatenate([folded(r, own) for r in rows])).view(U)
        for i in range(first, stop):
            others = np.arange(i + 1, int(np.searchsorted(sizes, 100 * sizes[i] // percent, "right")))
            others = others[labels[others] != labels[i]]
            if two:
                others = others[blocks[others] != blocks[i]]
            apart = np.bitwise_count(near[others - first] ^ near[i - first]).sum(1, dtype=np.int64)
            others = others[apart * (100 + percent) <= (100 - percent) * (sizes[others] + sizes[i])]
            while len(others):
                out.append((int(order[i]), int(order[others[0]])))
                labels[labels == labels[others[0]]] = labels[i]
                others = others[labels[others] != labels[i]]
    return out


def _sift_crowd(percent: int):
    """Pairs of sets that join what the bitmaps allow in a block or two of a crowd."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, prints, sizes, maps, blocks = None, [], [], [], []

        def done() -> pa.RecordBatch | None:
            pairs = allowed_pairs(np.array(sizes, np.int64), maps, np.array(blocks), percent) if len(prints) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([prints[i[k]] for i in pairs], pa.binary()) for k in (0, 1)], names=["a", "b"]) if pairs else None

        for batch in batches:
            for root, i, j, block, name, n, bits in zip(*(batch.column(c).to_pylist() for c in ("root", "i", "j", "block", "print", "n_shingles", "map"))):
                if (root, i, j) != current:
                    if (found := done()) is not None:
                        yield found
                    current, prints, sizes, maps, blocks = (root, i, j), [], [], [], []
                prints.append(name)
                sizes.append(n)
                maps.append(bits)
                blocks.append(block)
        if (found := done()) is not None:
            yield found
    return run


def linked_pairs(sets: list[np.ndarray], blocks: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Verified links that join the sets of one or two blocks of a cluster to components.

    Pairs already joined are not looked at again. A parity bitmap gives a lower bound of
    the number of differing shingles, which rules out most pairs; the others are compared whole.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    sizes, blocks = sizes[order], blocks[order]
    sets = [sets[i] for i in order]
    bits = 1 << max(9, min(16, int(sizes.max() * 2).bit_length()))
    maps = np.empty((m, bits // 64), U)
    for i, s in enumerate(sets):
        maps[i] = np.packbits((np.bincount((s & U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view(U)
    two = len(np.unique(blocks)) > 1
    labels = np.arange(m)
    out = []
    for i in range(m):
        end = int(np.searchsorted(sizes, 100 * sizes[i] // percent, "right"))
        others = np.arange(i + 1, end)
        others = others[labels[others] != labels[i]]
        if two:
            others = others[blocks[others] != blocks[i]]
        if not len(others):
            continue
        apart = np.bitwise_count(maps[others] ^ maps[i]).sum(1, dtype=np.int64)
        others = others[apart * (100 + percent) <= (100 - percent) * (sizes[others] + sizes[i])]
        while len(others):
            j = others[0]
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                out.append((int(order[i]), int(order[j])))
                labels[labels == labels[j]] = labels[i]
            others = others[1:]
            others = others[labels[others] != labels[i]]
    return out


def _verify(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sets, names, blocks = None, [], {}, []

        def done() -> pa.RecordBatch | None:
            ids = list(names)
            pairs = linked_pairs(sets, np.array(blocks), percent) if len(sets) > 1 else []
            if not pairs:
                return None
            return pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i, _ in pairs], pa.binary()), pa.array([ids[j] for _, j in pairs], pa.binary())], names=["a", "b"])

        for batch in batches:
            groups = list(zip(*(batch.column(c).to_pylist() for c in ("root", "i", "j"))))
            prints, block = batch.column("print").to_pylist(), batch.column("block").to_pylist()
            raw, offsets = flat_bytes(batch.column("text"))
            for lo, hi in row_chunks(offsets):
                for k, s in zip(range(lo, hi), shingle_sets(raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], width)):
                    if groups[k] != current:
                        if (found := done()) is not None:
                            yield found
                        current, sets, names, blocks = groups[k], [], {}, []
                    # Another text under the same doc_id has another set.
                    if prints[k] in names or hashlib.blake2b(s.tobytes(), digest_size=16).digest() != prints[k]:
                        continue
                    names[prints[k]] = len(sets)
                    sets.append(s)
                    blocks.append(block[k])
        if (found := done()) is not None:
            yield found
    return run


def _placed(members: DataFrame) -> DataFrame:
    """``members`` of roots with the number of blocks of the root and their own block."""
    blocks = members.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    return members.join(blocks, "root").withColumn("block", F.pmod(F.hash("print"), F.col("blocks")))


def _met_blocks(placed: DataFrame, *columns: str) -> DataFrame:
    """Rows once for each block that theirs meets, the rows of two blocks (``i``, ``j``) in one task."""
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "print", *columns)
    return met.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")


def _wanted(texts: DataFrame, members: DataFrame) -> DataFrame:
    """``texts`` without nearly all that are no ``rep`` of ``members``, so that the join does not shuffle every text."""
    slot = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - WANTED_BITS)
    at = slot("rep") + 1
    marked = members.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    bits = np.zeros((1 << WANTED_BITS) // 8, np.uint8)
    for r in marked.collect():
        part = np.frombuffer(bytes(r.bits), np.uint8)
        bits[(r.bucket - 1) * len(part):r.bucket * len(part)] = part
    marks = texts.sparkSession.sparkContext.broadcast(bits.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(marks.value, np.uint8)
        for batch in batches:
            slots = column(batch, "slot")
            kept = batch.filter(pa.array((held[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool)))
            if kept.num_rows:
                yield kept.select(["doc_id", "text"])
    return texts.withColumn("slot", slot("doc_id")).mapInArrow(released(run), texts.schema)


def jaccard_classes(docs: DataFrame, scratch: Scratch, *, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` of every row of ``docs`` (doc_id, text).

    Two documents are linked when 100 * |intersection| >= percent * |union| of their sets of
    ``width``-word shingles (A-Z lower-cased); ``component_id`` is the least doc_id reachable by links.
    """
    levels = Levels(percent)
    texts = docs.select("doc_id", "text")
    context = texts.sparkSession.sparkContext
    scanned = scratch.write(
        texts.mapInArrow(released(_scan(width, levels)),
                         "doc_id long, n_shingles long, print binary, node long, map binary, part int, counts binary"), "sets")
    sets = scanned.where("part is null").select("doc_id", "n_shingles", "print", "node", "map")
    counts = scanned.where("part is not null").select("part", "counts").repartition(SKETCH_PARTS, "part")
    sums = {r.part: bytes(r.counts) for r in counts.mapInArrow(released(_add_counts), "part int, counts binary").collect()}
    blank = bytes(2 * (1 << SLOT_BITS) // SKETCH_PARTS)
    slot_counts = context.broadcast(b"".join(sums.get(k, blank) for k in range(SKETCH_PARTS)))

    keys = texts.select("text").mapInArrow(released(_index(width, levels, slot_counts)), "key long, node long")
    proposed = scratch.write(keys.repartition("key").mapInArrow(released(_meet), "a long, b long, crowd boolean"), "proposed")

    one = sets.where("n_shingles > 0").groupBy("print").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("node").alias("node"), F.first("map").alias("map"))
    one = scratch.write(one, "distinct")
    ends = one.where("map is not null")
    x, y = (ends.select(F.col("node").alias(n), F.col("print").alias(p), F.col("n_shingles").alias(f"{p}_size"), F.col("map").alias(f"{p}_map"))
            for n, p in (("a", "x"), ("b", "y")))
    pairs = proposed.where("not crowd").select("a", "b").distinct().join(x, "a").join(y, "b").drop("a", "b")
    allowed = scratch.write(pairs.mapInArrow(released(_sift(percent)), "a binary, b binary"), "pairs")
    crowds = components(proposed.where("crowd").select("a", "b"), scratch)
    met = _met_blocks(_placed(ends.join(crowds, "node")), "n_shingles", "map")
    crowded = scratch.write(met.mapInArrow(released(_sift_crowd(percent)), "a binary, b binary"), "crowds")

    clusters = components(allowed.unionByName(crowded), scratch)
    members = scratch.write(one.join(clusters, one["print"] == clusters["node"]).select("print", "rep", "root"), "members")
    met = _met_blocks(_wanted(texts, members).join(_placed(members), F.col("doc_id").eqNullSafe(F.col("rep"))), "text")
    links = scratch.write(met.mapInArrow(released(_verify(width, percent)), "a binary, b binary"), "links")
    joined = components(links, scratch)

    classes = one.join(joined, one["print"] == joined["node"], "left").select(
        one["print"], "rep", F.coalesce("root", one["print"]).alias("root"))
    least = classes.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = scratch.write(classes.join(least, "root").select("print", "component_id"), "classes")
    alone = sets.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return sets.where("n_shingles > 0").join(named, "print").select("doc_id", "n_shingles", "component_id").unionByName(alone)
