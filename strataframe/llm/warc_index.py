"""WARC archives, and their global index by external merge.

Each task writes gzip archives, a member per record, and beside them a capture run: the index rows of its records, sorted by
URL key and time. The runs are merged by a k-way loser tree to one index ordered by URL key, time, archive and offset. Merging is cut
twice: into ranges of keys, found from keys sampled in the runs, so one URL's captures spread over ranges by
time; and into passes of at most ``FAN_IN`` runs, so no task opens more. Runs are written and read through the filesystem of the shared
folder, in row groups whose key bounds let a merge skip what lies outside its range.

Of records with equal payloads (by SHA-256) the one with the least page_id is a response and later ones revisit it.

Defined results: null html is an empty payload; a null URL has an empty key and no target header; a null page_id is a response and never
revisited; rows that repeat a page_id with one payload are responses all; an empty table gives no archive and no row; further columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, functions as F

from strataframe.llm.shared import Scratch

FAN_IN = 64
#: Captures of a merge range and of a row group of a run; bytes of an archive.
RANGE_ROWS = 1 << 16
GROUP_ROWS = 1 << 12
#: Sampled keys for each range that reach the driver, about.
KEYS = 4
ARCHIVE_BYTES = 1 << 28
CRLF = b"\r\n"

CAPTURE = pa.schema([("urlkey", pa.string()), ("time", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
CAPTURE_SQL = "urlkey string, time string, archive string, offset long, length long"


def url_key(url: str | None) -> str:
    """Host labels from the last to the first, then what follows the host, without fragment; lower case host, default ports dropped."""
    if not url:
        return ""
    scheme, mark, rest = url.partition("://")
    rest = (rest if mark else url).partition("#")[0]
    cut = min((rest.find(c) for c in "/?" if c in rest), default=len(rest))
    host, _, port = rest[:cut].lower().rpartition("@")[2].partition(":")
    port = "" if port in ("", "80", "443") else ":" + port
    return ",".join(reversed(host.split("."))) + port + ")" + (rest[cut:] or "/")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url, time, payload: bytes, refers_to, refers_url) -> bytes:
    """One WARC record. A revisit keeps the HTTP head, whose Content-Length is that of the full payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + (payload if refers_to is None else b"")
    clean = lambda u: "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in u)
    fields = [("WARC-Type", "response" if refers_to is None else "revisit")]
    if url is not None:
        fields.append(("WARC-Target-URI", clean(url)))
    fields += [("WARC-Date", time), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {time}')}>"),
               ("WARC-Payload-Digest", "sha1:" + base32_sha1(payload)), ("WARC-Block-Digest", "sha1:" + base32_sha1(block))]
    if refers_to is not None:
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        fields.append(("WARC-Refers-To-Page", str(refers_to)))
        if refers_url is not None:
            fields.append(("WARC-Refers-To-Target-URI", clean(refers_url)))
    if page_id is not None:
        fields.append(("WARC-Page", str(page_id)))
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + CRLF + block + CRLF + CRLF


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Fields, HTTP head and payload of a record."""
    head, _, rest = data.partition(CRLF + CRLF)
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines)
    http, _, payload = rest[:int(fields["Content-Length"])].partition(CRLF + CRLF)
    return fields, http, payload


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


class LoserTree:
    """Merges sorted iterators. An inner node keeps the loser of its match, so the next row costs one match per level."""

    def __init__(self, sources: list[Iterator[tuple]]):
        self.sources, self.k = sources, len(sources)
        self.rows = [next(s, None) for s in sources]
        self.losers = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.rows[a], self.rows[b]
        if x is None or y is None:
            return x is not None
        return x < y if x != y else a < b

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = winner
                return
            if self._beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and (row := self.rows[self.losers[0]]) is not None:
            yield row
            i = self.losers[0]
            self.rows[i] = next(self.sources[i], None)
            self._play(i)


def _run_rows(store, path: str, low: tuple | None, high: tuple | None) -> Iterator[tuple]:
    """Rows of a run in [low, high); row groups wholly outside are not read."""
    with store.open_input_file(path) as f:
        file = pq.ParquetFile(f)
        for g in range(file.num_row_groups):
            stats = file.metadata.row_group(g).column(0).statistics
            if stats is not None and stats.has_min_max and ((low and stats.max < low[0]) or (high and stats.min > high[0])):
                continue
            rows = file.read_row_group(g)
            for row in zip(*(rows.column(c).to_pylist() for c in CAPTURE.names)):
                if high and row >= high:
                    return
                if not low or row >= low:
                    yield row


def _write_run(store, path: str, rows: Iterator[tuple], every: int = 1 << 62) -> tuple[int, tuple | None, tuple | None, list[tuple]]:
    """Writes sorted rows; returns their number, first and last, and one key for each ``every`` of them."""
    held, n, first, last, keys = [], 0, None, None, []
    with store.open_output_stream(path) as out, pq.ParquetWriter(out, CAPTURE, compression="zstd") as writer:
        def flush() -> None:
            writer.write_table(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), CAPTURE.types)], schema=CAPTURE))
            held.clear()

        for row in rows:
            if n % every == 0:
                keys.append(row)
            first, last, n = first or row, row, n + 1
            held.append(row)
            if len(held) == GROUP_ROWS:
                flush()
        if held:
            flush()
    return n, first, last, keys


MANIFEST = "run string, n long, first struct<{0}>, last struct<{0}>, keys array<struct<{0}>>".format(CAPTURE_SQL.replace(" string", ":string").replace(" long", ":long"))
_ROW = pa.struct(list(CAPTURE))


def _as_row(t: tuple | None) -> dict | None:
    return None if t is None else dict(zip(CAPTURE.names, t))


def _archive_writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        out, name, at, rows = None, "", 0, []
        for batch in batches:
            for page_id, url, time, html, refers_to, refers_url in zip(*(batch.column(c).to_pylist() for c in (
                    "page_id", "url", "time", "html", "refers_to", "refers_url"))):
                if out is None or at > ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    # A task that is tried again writes files of its own; only those of the run it returns are used.
                    name, at = f"archive-{uuid.uuid4().hex}.warc.gz", 0
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                data = packer.compress(record(page_id, url, time, (html or "").encode(), refers_to, refers_url)) + packer.flush()
                out.write(data)
                rows.append((url_key(url), time, name, at, len(data)))
                at += len(data)
        if out is not None:
            out.close()
        if rows:
            rows.sort()
            path = f"run-{uuid.uuid4().hex}.parquet"
            n, first, last, keys = _write_run(store, f"{base}/{path}", iter(rows), max(1, min(RANGE_ROWS // KEYS, len(rows) // 16)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([path]), pa.array([n]), pa.array([_as_row(first)], _ROW), pa.array([_as_row(last)], _ROW),
                 pa.array([[_as_row(k) for k in keys]], pa.list_(_ROW))], names=["run", "n", "first", "last", "keys"])
    return run


def write_archives(pages: DataFrame, folder: str, scratch: Scratch, min_bytes: int = 0) -> DataFrame:
    """Archives and sorted runs of ``pages`` (page_id, url, time, html) in ``folder``; returns the manifest of runs.

    ``time``: text like 2024-05-01T00:00:00Z. Payloads of fewer than ``min_bytes`` bytes are never revisited.
    """
    rows = pages.select("page_id", "url", "time", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    narrow = rows.where(F.octet_length("html") >= min_bytes).select("page_id", "url", "digest")
    first = narrow.where("page_id is not null").groupBy("digest").agg(
        F.min(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n")).where("n > 1")
    revisits = narrow.join(first, "digest").where(F.col("page_id") > F.col("first.page_id")).select(
        "page_id", "digest", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url")).distinct()
    joined = rows.join(revisits, ["page_id", "digest"], "left")
    return scratch.write(joined.drop("digest").mapInArrow(_archive_writer(folder), MANIFEST), "manifest")


def splitters(manifest: DataFrame, range_rows: int = RANGE_ROWS) -> list[tuple]:
    """Keys that cut all runs to ranges of about ``range_rows`` captures.

    The keys sampled in the runs are thinned by their hash to about ``KEYS`` for each range before they reach the driver;
    they decide how even the ranges are, never which rows are merged.
    """
    keys = manifest.select(F.explode("keys").alias("k"), (F.col("n") / F.size("keys")).alias("weight"))
    chance = F.least(F.lit(1.0), F.col("weight") * KEYS / range_rows)
    keys = keys.where(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < chance * (1 << 30)).withColumn("weight", F.col("weight") / chance)
    out, weight = [], 0.0
    for row in sorted(keys.collect(), key=lambda r: tuple(r.k)):
        if weight >= range_rows:
            out.append(tuple(row.k))
            weight = 0.0
        weight += row.weight
    return out


def _ranges(cuts: list[tuple]):
    """The ranges that each run reaches into."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, path = [], []
            for name, first, last in zip(*(batch.column(c).to_pylist() for c in ("run", "first", "last"))):
                for r in range(bisect.bisect_right(cuts, tuple(first.values())), bisect.bisect_right(cuts, tuple(last.values())) + 1):
                    part.append(r)
                    path.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(path, pa.string())], names=["part", "run"])
    return run


def _merged(folder: str, cuts: list[tuple], part: int, runs: list[str], sliced: bool) -> Iterator[tuple]:
    store, base = _open(folder)
    low, high = (cuts[part - 1] if part else None), (cuts[part] if part < len(cuts) else None)
    return iter(LoserTree([_run_rows(store, f"{base}/{r}", low if sliced else None, high if sliced else None) for r in sorted(runs)]))


def _merge_pass(folder: str, cuts: list[tuple], sliced: bool):
    """Merges the runs of each (range, group) to one run."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = []
            store, base = _open(folder)
            for part, runs in zip(batch.column("part").to_pylist(), batch.column("runs").to_pylist()):
                names.append(f"run-{uuid.uuid4().hex}.parquet")
                _write_run(store, f"{base}/{names[-1]}", _merged(folder, cuts, part, runs, sliced))
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(names, pa.string())], names=["part", "run"])
    return run


def _last_pass(folder: str, cuts: list[tuple], sliced: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(part: int, place: int, rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), CAPTURE.types)]
            n = len(rows)
            return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int64()), pa.array(range(place, place + n), pa.int64()), *columns],
                                              names=["part", "place", *CAPTURE.names])

        for batch in batches:
            for part, runs in zip(batch.column("part").to_pylist(), batch.column("runs").to_pylist()):
                held, place = [], 0
                for row in _merged(folder, cuts, part, runs, sliced):
                    held.append(row)
                    if len(held) == GROUP_ROWS:
                        yield out(part, place, held)
                        place, held = place + len(held), []
                if held:
                    yield out(part, place, held)
    return run


def merge_index(manifest: DataFrame, folder: str, scratch: Scratch, *, range_rows: int = RANGE_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """The capture rows of all runs in global order of ``part`` and ``place``: urlkey, time, archive, offset, length."""
    cuts = splitters(manifest, range_rows)
    runs = scratch.write(manifest.select("run", "first", "last").mapInArrow(_ranges(cuts), "part long, run string"), "ranges")
    sliced = True
    while True:
        sizes = runs.groupBy("part").agg(F.count("*").alias("runs"))
        most = sizes.agg(F.max("runs")).first()[0] or 0
        if most <= fan_in:
            break
        # Runs fall into groups by hash; a group that got too many is split again by the next pass.
        group = runs.join(sizes, "part").withColumn("group", F.pmod(F.xxhash64("run"), F.ceil(F.col("runs") / (fan_in / 2)).cast("long")))
        groups = group.groupBy("part", "group").agg(F.collect_list("run").alias("runs")).repartition("part", "group")
        runs = scratch.write(groups.select("part", "runs").mapInArrow(_merge_pass(folder, cuts, sliced), "part long, run string"), "pass")
        sliced = False
    last = runs.groupBy("part").agg(F.collect_list("run").alias("runs"))
    return scratch.write(last.mapInArrow(_last_pass(folder, cuts, sliced), "part long, place long, " + CAPTURE_SQL), "index")


def _archive_reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        name, file = None, None
        for batch in batches:
            out = []
            for key, time, archive, offset, length in zip(*(batch.column(c).to_pylist() for c in CAPTURE.names)):
                if archive != name:
                    if file is not None:
                        file.close()
                    name, file = archive, store.open_input_file(f"{base}/{archive}")
                file.seek(offset)
                fields, http, payload = parse(zlib.decompress(file.read(length), 31))
                kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                size = int(http.rpartition(b"Content-Length: ")[2])
                if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
                    raise ValueError(f"{archive} at {offset}: payload and digest differ")
                page, refers = fields.get("WARC-Page"), fields.get("WARC-Refers-To-Page")
                out.append((page and int(page), fields.get("WARC-Target-URI"), key, time, kind, refers and int(refers), size, digest,
                            payload if kind == "response" else None))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[f.split()[0] for f in RECORD.split(", ")])
        if file is not None:
            file.close()
    return run


RECORD = ("page_id long, url string, urlkey string, time string, record_type string, refers_to long, payload_bytes long, "
          "payload_digest string, payload binary")


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """The records of an index, in ``RECORD``; each archive is opened once, by the task that its captures are dealt to, in file order."""
    return index.select(*CAPTURE.names).repartition("archive").sortWithinPartitions("archive", "offset").mapInArrow(_archive_reader(folder), RECORD)
