"""Removal of byte strings that also start in a document with a smaller doc_id.

Bucket-pointer refinement, spread over tasks. Every string of ``length`` bytes holds one
anchor: the q-gram with the least hash among those inside it, so equal strings have their anchor
at the same place. The initial buckets are the anchors' q-grams, read in sorted runs. A bucket seen in one text
only is done. For the rest, each occurrence sends the bytes around its anchor that its strings
cover; within a bucket the strings are refined by sorting on pointers (bucket numbers) of later
offsets, and the numbers found for one offset are reused at the next, until they stand for the
whole string. The least doc_id per final bucket decides. A bucket of more than ``HOT`` contexts is not refined in its task:
its strings go on one by one and meet in a shuffle on the string itself.

Nothing is capped: very long texts are cut into overlapping segments, exact copies of a whole text are settled
by its digest, and equal occurrences in one task are combined before the shuffle, so a passage in a third of all
rows is one row per task.

Defined results: a null text is empty; a text shorter than ``length`` loses nothing; rows that share a doc_id do not
remove from each other, since neither is smaller, and each loses only what repeats in its own text; a null doc_id is neither a source nor loses anything; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strataframe.llm.hashing import U, Ranges
from strataframe.llm.shared import Scratch, column, flat_bytes, released, row_chunks

#: Bytes of the initial buckets' q-grams.
Q = 16
#: Bytes of one numpy pass; longer texts are cut into segments of this many string starts.
SEGMENT = 1 << 19
#: Anchors a task gathers before it combines equal ones, and texts it remembers.
COMBINE_ROWS = 1 << 19
#: Contexts refined in one numpy pass, and contexts of one bucket beyond which its strings are compared in a shuffle.
RUN_ROWS = 1 << 12
HOT = 1 << 14
#: Bits of a packed position within one numpy pass (segments and chunks are shorter), the others hold the hash.
PLACE_BITS = 25


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all strings of ``length`` bytes inside the rows of a buffer.

    Returns row, place, first and last start of the strings it is the anchor of, and the hash of its q-gram.
    """
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none, none, none, np.zeros(0, U)
    grams = Ranges(raw).grams(Q)
    width = length - Q + 1
    packed = (grams & ~U((1 << PLACE_BITS) - 1)) | np.arange(len(grams), dtype=U)
    least, span = packed, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[:len(least) - (width - span)], least[width - span:])
    ends = np.repeat(offsets[1:], np.diff(offsets))[:len(least)]
    starts = np.flatnonzero(np.arange(length, len(least) + length) <= ends)
    if not len(starts):
        return none, none, none, none, np.zeros(0, U)
    place = (least[starts] & U((1 << PLACE_BITS) - 1)).astype(np.int64)
    rows = np.searchsorted(offsets, starts, "right") - 1
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (rows[1:] != rows[:-1])
    heads = np.flatnonzero(new)
    tails = np.r_[heads[1:], len(starts)] - 1
    place = place[heads]
    return rows[heads], place, starts[heads], starts[tails], grams[place]


def segments(raw: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of the buffer for one numpy pass: bytes, offsets, row of each piece, and its start within the row."""
    for lo, hi in row_chunks(offsets, SEGMENT):
        if hi - lo == 1 and offsets[hi] - offsets[lo] > SEGMENT + length:
            for start in range(0, int(offsets[hi] - offsets[lo]), SEGMENT):
                a = offsets[lo] + start
                b = min(offsets[hi], a + SEGMENT + length - 1)
                yield raw[a:b], np.array([0, b - a]), np.array([lo]), np.array([start])
        else:
            yield raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], np.arange(lo, hi), np.zeros(hi - lo, np.int64)


def _packed(place: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Anchor place with its reach: place << 16 | place - first << 8 | place - last."""
    return place << 16 | (place - first) << 8 | (place - last)


def _anchor_rows(length: int):
    """Rows (bucket, text, at, known): per task one row of each bucket goes on, and rows known to repeat pass through."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()

        def combined() -> pa.RecordBatch:
            bucket, text, at = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((text, bucket))
            bucket, text, at = bucket[order], text[order], at[order]
            new = np.ones(len(bucket), bool)
            new[1:] = bucket[1:] != bucket[:-1]
            group = np.cumsum(new) - 1
            heads = np.flatnonzero(new)
            many = np.zeros(len(heads), bool)
            np.logical_or.at(many, group, text != text[heads][group])
            # A bucket of several texts: all its rows are known to repeat, and one tells the other tasks.
            rest = np.flatnonzero(many[group] & ~new)
            single = np.flatnonzero(~many[group] & ~new)
            rows = np.r_[heads, single, rest]
            known = np.r_[many.astype(np.int32), np.zeros(len(single), np.int32), np.full(len(rest), 2, np.int32)]
            # Pass-through rows need no bucket; their text's hash spreads them.
            bucket = np.r_[bucket[heads], bucket[single], text[rest]]
            return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(text[rows]), pa.array(at[rows]), pa.array(known)],
                                              names=["bucket", "text", "at", "known"])

        for batch in batches:
            raw, offsets = flat_bytes(batch.column("text"))
            names = batch.column("name").to_numpy(zero_copy_only=False)
            if len(seen) > COMBINE_ROWS:
                seen.clear()  # a copy met again only repeats rows
            fresh = np.array([n not in seen and not seen.add(n) for n in names.tolist()], bool)
            for part, offs, of, start in segments(raw, offsets, length):
                row, place, first, last, gram = anchors(part, offs, length)
                keep = fresh[of[row]]
                row, place, first, last, gram = row[keep], place[keep], first[keep], last[keep], gram[keep]
                shift = start[row] - offs[row]
                held.append((gram.view(np.int64), names[of[row]], _packed(place + shift, first + shift, last + shift)))
                size += len(row)
                if size > COMBINE_ROWS:
                    yield combined()
                    held, size = [], 0
        if size:
            yield combined()
    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors (name, at) whose bucket holds more than one text; the rows come sorted by bucket."""
    def repeats(bucket, text, at, known):
        new = np.ones(len(bucket), bool)
        new[1:] = bucket[1:] != bucket[:-1]
        group, heads = np.cumsum(new) - 1, np.flatnonzero(new)
        many = np.zeros(len(heads), bool)
        np.logical_or.at(many, group, (text != text[heads][group]) | (known == 1))
        return many[group]

    held = None
    for batch in batches:
        bucket, text, at, known = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "text", "at", "known"))
        passed = known == 2
        out = [(text[passed], at[passed])]
        rows = [x[~passed] for x in (bucket, text, at, known)]
        if held is not None:
            rows = [np.r_[h, x] for h, x in zip(held, rows)]
        if len(rows[0]):
            cut = int(np.searchsorted(rows[0], rows[0][-1], "left"))
            keep = repeats(*[x[:cut] for x in rows])
            out.append((rows[1][:cut][keep], rows[2][:cut][keep]))
            held = [x[cut:] for x in rows]
            if repeats(*held).any():
                # Known to repeat: its rows go, and one row tells those to come.
                out.append((held[1], held[2]))
                held = [x[:1] for x in held]
                held[3] = np.ones(1, np.int32)
            else:
                _, first = np.unique(held[2], return_index=True)
                held = [x[first] for x in held]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["name", "at"])
    if held is not None:
        keep = repeats(*held)
        yield pa.RecordBatch.from_arrays([pa.array(held[1][keep]), pa.array(held[2][keep])], names=["name", "at"])


def _contexts(length: int):
    """Rows (bucket, doc, name, start, count, data) around repeated anchors; a row without bytes is a whole covered stretch.

    Of equal contexts in one task the one of the least document goes on; the others repeat it and are covered.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[bytes, list[tuple[int, int, int, int]]] = {}

        def flush() -> pa.RecordBatch:
            held = [(int.from_bytes(hashlib.blake2b(k[1 + k[0]:1 + k[0] + Q], digest_size=8).digest(), "big", signed=True), *place, k)
                    for k, places in least.items() for place in places]
            least.clear()
            return rows(*zip(*held))

        def rows(bucket, doc, name, start, count, data) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(bucket, pa.int64()), pa.array(doc, pa.int64()), pa.array(name, pa.int64()), pa.array(start, pa.int64()),
                 pa.array(count, pa.int32()), pa.array(data, pa.binary())], names=["bucket", "doc", "name", "start", "count", "data"])

        for batch in batches:
            docs, names = batch.column("doc_id").to_pylist(), batch.column("name").to_pylist()
            places = batch.column("places").to_numpy(zero_copy_only=False)
            raw, offsets = flat_bytes(batch.column("text"))
            data = raw.tobytes()
            covered: list[tuple[int, int, int, int]] = []
            for k, doc in enumerate(docs):
                base = int(offsets[k])
                at = np.asarray(places[k], np.int64)
                place, first, last = at >> 16, (at >> 16) - (at >> 8 & 255), (at >> 16) - (at & 255)
                for p, f, e in zip(place.tolist(), first.tolist(), last.tolist()):
                    key = bytes((p - f,)) + data[base + f:base + e + length]
                    mine, others = (doc, names[k], f, e - f + 1), least.get(key)
                    if others is None:
                        least[key] = [mine]
                    elif others[0][0] > doc:
                        covered += others
                        least[key] = [mine]
                    elif others[0][0] == doc:
                        others.append(mine)
                    else:
                        covered.append(mine)
            if covered:
                d, n, s, c = zip(*covered)
                yield rows(n, d, n, s, c, [None] * len(d))
            if len(least) > COMBINE_ROWS // 4:
                yield flush()
        if least:
            yield flush()
    return run


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Bucket numbers: equal rows of the key columns get one number, in the keys' order."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), np.int64)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def refined(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all strings of ``length`` bytes in the rows of a buffer; equal strings have equal numbers.

    Bucket-pointer refinement: pointers of 8 bytes are the bytes themselves; a bucket of 8, 16, 32 ... bytes is
    refined by the bucket number at the offset it covers already; the last step overlaps. Returns starts and numbers.
    """
    ends = np.repeat(offsets[1:], np.diff(offsets))
    at = np.arange(len(raw))
    words = np.zeros(len(raw), U)
    for i in range(8):
        words[:len(raw) - i] |= raw[i:].astype(U) << U(8 * (7 - i))
    known, numbers, starts = 8, words, at[at + 8 <= ends]
    while known < length:
        reach = min(2 * known, length)
        starts = at[at + reach <= ends]
        found = np.zeros(len(raw), np.int64)
        found[starts] = _dense(numbers[starts], numbers[starts + reach - known])
        known, numbers = reach, found
    return starts, numbers[starts]


def _judged(rows: pa.Table, length: int) -> list[tuple]:
    """Covered stretches (doc, name, start, end) of contexts whose buckets are all there."""
    doc, name, start, count, bucket = (column(rows, c) for c in ("doc", "name", "start", "count", "bucket"))
    # Equal contexts first: all but the least document repeat it.
    coded = rows.column("data").combine_chunks()
    coded = (coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded).dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    texts = coded.dictionary
    least = np.full(len(texts), np.iinfo(np.int64).max)
    np.minimum.at(least, code, doc)
    later = doc > least[code]
    out = [(doc[later], name[later], start[later], start[later] + count[later] + length - 1)]
    # A bucket with one context only is done; the contexts of the others are refined.
    of = np.zeros(len(texts), np.int64)
    of[code] = bucket
    _, group, sizes = np.unique(of, return_inverse=True, return_counts=True)
    part = np.flatnonzero(sizes[group] > 1)
    if not len(part):
        return out
    raw, offsets = flat_bytes(texts.take(pa.array(part)))
    s, number = refined(raw, offsets, length)
    row = np.searchsorted(offsets, s, "right") - 1
    keep = s > offsets[row]  # the leading byte tells the anchor's place
    s, number, row = s[keep], number[keep], row[keep]
    owner = least[part][row]
    order = np.lexsort((owner, number))
    lead = np.r_[True, number[order][1:] != number[order][:-1]]
    best = np.empty(len(order), np.int64)
    best[order] = owner[order][np.flatnonzero(lead)[np.cumsum(lead) - 1]]
    covered_by: dict[int, list[int]] = {}
    hit = best < owner
    for r, p in zip(part[row[hit]].tolist(), (s - offsets[row] - 1)[hit].tolist()):
        covered_by.setdefault(r, []).append(p)
    found = []
    for k in np.flatnonzero(~later).tolist():
        if (at := covered_by.get(int(code[k]))) is not None:
            p = np.array(at)
            cut = np.flatnonzero(np.diff(p) > length)
            heads, tails = p[np.r_[0, cut + 1]], p[np.r_[cut, len(p) - 1]]
            found += [(doc[k], name[k], a, b) for a, b in zip((start[k] + heads).tolist(), (start[k] + tails + length).tolist())]
    return out + [tuple(np.array(x, np.int64) for x in zip(*found))] if found else out


def _verdicts(length: int, hot: int = HOT):
    """Covered stretches (doc_id, name, start, end) of the strings that also start in a smaller document; the rows come sorted by bucket.

    Rows with ``data`` are the strings of a bucket too large to refine here, still to be compared.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(found: list[tuple]) -> pa.RecordBatch:
            d, n, a, b = (np.concatenate(x).astype(np.int64) for x in zip(*found))
            return pa.RecordBatch.from_arrays([pa.array(d), pa.array(n), pa.array(a), pa.array(b), pa.nulls(len(d), pa.binary())],
                                              names=["doc_id", "name", "start", "end", "data"])

        def strings(tbl: pa.Table) -> Iterator[pa.RecordBatch]:
            for batch in tbl.to_batches(max_chunksize=RUN_ROWS):
                doc, name, start, count = (np.repeat(batch.column(c).to_numpy(), batch.column("count").to_numpy()) for c in ("doc", "name", "start", "count"))
                inside = np.arange(len(doc)) - np.repeat(np.cumsum(batch.column("count").to_numpy()) - batch.column("count").to_numpy(), batch.column("count").to_numpy())
                data = [d[1 + i:1 + i + length] for d, c in zip(batch.column("data").to_pylist(), batch.column("count").to_pylist()) for i in range(c)]
                at = start + inside
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(name), pa.array(at), pa.array(at + length), pa.array(data, pa.binary())],
                                                 names=["doc_id", "name", "start", "end", "data"])

        held, size, large = [], 0, None
        for batch in batches:
            whole = batch.column("data").is_null().to_numpy(zero_copy_only=False)
            if whole.any():
                doc, name, start, count = (batch.column(c).to_numpy()[whole] for c in ("doc", "name", "start", "count"))
                yield rows([(doc, name, start, start + count + length - 1)])
            contexts = batch.filter(pa.array(~whole))
            for lo in range(0, contexts.num_rows, RUN_ROWS):
                piece = contexts.slice(lo, RUN_ROWS)
                if large is not None:
                    # What is left of a large bucket goes on at once.
                    same = int(np.searchsorted(column(piece, "bucket"), large, "right"))
                    yield from strings(pa.Table.from_batches([piece.slice(0, same)]))
                    piece = piece.slice(same)
                    if not piece.num_rows:
                        continue
                    large = None
                held.append(piece)
                size += piece.num_rows
                if size < RUN_ROWS:
                    continue
                tbl = pa.Table.from_batches(held).combine_chunks()
                bucket = column(tbl, "bucket")
                cut = int(np.searchsorted(bucket, bucket[-1], "left"))
                if cut:
                    yield rows(_judged(tbl.slice(0, cut).combine_chunks(), length))
                held, size = [], 0
                if len(bucket) - cut > hot:
                    large = bucket[-1]
                    yield from strings(tbl.slice(cut))
                else:
                    held = tbl.slice(cut).to_batches()
        if held:
            yield rows(_judged(pa.Table.from_batches(held).combine_chunks(), length))
    return run


def _later(strings: DataFrame) -> DataFrame:
    """Of strings (doc_id, name, start, end, data) those that also start in a smaller document."""
    first = strings.groupBy("data").agg(F.min("doc_id").alias("first"))
    return strings.join(first, "data").where("doc_id > first").select("doc_id", "name", "start", "end")


def repeated_spans(docs: DataFrame, scratch: Scratch, length: int = 50, hot: int = HOT) -> DataFrame:
    """Per text that loses bytes: ``doc_id``, ``name`` (its hash), ``whole``, ``spans`` (start and end of stretches, unmerged).

    ``whole``: the text is a copy of a text with a smaller doc_id, and every byte goes.
    """
    name = F.xxhash64(F.coalesce("text", F.lit("")))
    named = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), name.alias("name")).where(
        F.octet_length("text") >= length)
    texts = scratch.write(named.where("doc_id is not null").select("doc_id", "name", F.sha2("text", 256).alias("digest")), "texts")
    first = texts.groupBy("name", "digest").agg(F.min("doc_id").alias("first"))
    first = scratch.write(first, "first")

    rows = named.where("doc_id is not null").select("name", "text").mapInArrow(
        released(_anchor_rows(length)), "bucket long, text long, at long, known int")
    by_bucket = lambda df: df.repartition("bucket").sortWithinPartitions("bucket")
    repeats = scratch.write(by_bucket(rows).mapInArrow(released(_repeated), "name long, at long"), "repeats")
    places = repeats.groupBy("name").agg(F.collect_set("at").alias("places"))
    wanted = first.join(places, "name").select(F.col("first").alias("doc_id"), "name", "places")
    around = named.join(wanted, ["doc_id", "name"]).select("doc_id", "name", "text", "places").mapInArrow(
        released(_contexts(length)), "bucket long, doc long, name long, start long, count int, data binary")
    found = scratch.write(by_bucket(around).mapInArrow(released(_verdicts(length, hot)), "doc_id long, name long, start long, end long, data binary"), "spans")
    stretches = found.where("data is null").drop("data").unionByName(_later(found.where("data is not null")))
    spans = stretches.groupBy("doc_id", "name").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    copies = texts.join(first, ["name", "digest"]).where("doc_id > first").select("doc_id", "name").distinct()
    kept = first.select(F.col("first").alias("doc_id"), "name").join(spans, ["doc_id", "name"])
    return copies.select("doc_id", "name", F.lit(True).alias("whole"), F.lit(None).cast("array<struct<start:long,end:long>>").alias("spans")).union(
        kept.select("doc_id", "name", F.lit(False), "spans"))


def _apply(as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = flat_bytes(batch.column("text"))
            data = raw.tobytes()
            whole, spans = batch.column("whole").to_pylist(), batch.column("spans")
            kept, removed, runs, total = [], [], [], []
            for k in range(batch.num_rows):
                text = data[offsets[k]:offsets[k + 1]]
                total.append(len(text))
                merged: list[list[int]] = []
                if whole[k]:
                    merged = [[0, len(text)]]
                elif spans[k].is_valid:
                    flat = spans[k].values
                    a, b = flat.field("start").to_numpy(), flat.field("end").to_numpy()
                    order = np.argsort(a, kind="stable")
                    a, b = a[order], np.maximum.accumulate(b[order])
                    heads = np.flatnonzero(np.r_[True, a[1:] > b[:-1]])
                    merged = list(zip(a[heads].tolist(), b[np.r_[heads[1:] - 1, len(b) - 1]].tolist()))
                pieces, last = [], 0
                for a, b in merged:
                    pieces.append(text[last:a])
                    last = b
                pieces.append(text[last:])
                removed.append(len(text) - sum(map(len, pieces)))
                # As text, each piece loses the bytes of a character that was cut.
                kept.append("".join(p.decode("utf-8", "ignore") for p in pieces) if as_text else b"".join(pieces))
                runs.append([{"start": a, "end": b} for a, b in merged])
            arrays = [batch.column(c) for c in batch.schema.names if c not in ("text", "whole", "spans")]
            names = [c for c in batch.schema.names if c not in ("text", "whole", "spans")]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.string() if as_text else pa.binary())],
                names=[*names, "n_bytes", "n_removed", "removed", "kept"])
    return run


def remove_repeats(
    docs: DataFrame, scratch: Scratch, length: int = 50, *, extra: list[Column] | None = None, as_text: bool = False, hot: int = HOT
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): ``doc_id``, ``n_bytes``, ``n_removed``, ``removed`` (maximal stretches), ``kept``.

    Bytes are counted in UTF-8. ``kept`` is bytes or, with ``as_text``, text without characters that lost some of their bytes.
    ``extra`` columns of ``docs`` are carried along.
    """
    spans = repeated_spans(docs.select("doc_id", "text"), scratch, length, hot)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *(extra or [])).withColumn("name", F.xxhash64("text"))
    joined = rows.join(spans, ["doc_id", "name"], "left").drop("name")
    kept = [f for f in joined.schema if f.name not in ("text", "whole", "spans")]
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return joined.mapInArrow(released(_apply(as_text)), f"{shape}, n_bytes long, n_removed long, removed array<struct<start:long,end:long>>, kept {'string' if as_text else 'binary'}")
