"""WARC archives with a two-level capture index.

Writing. Each task writes archives of gzip members, one WARC record per
member, under names no other attempt uses, begins another beyond ``ROLL``
bytes, and moves each into place when it is complete; the rows the task returns name the file, so only archives of
successful attempts are ever read. A payload that several records share is
stored once, in the record of the largest page id; the others are revisits.

Index. Entries (reversed-host URL key, page id, file, offset, length) are
range-partitioned and sorted by key, and every ``LINES`` of them become one
compressed block. Level one is the sparse directory: the first key, file,
offset and length of each block. A lookup binary-searches the directory for
the blocks its key can be in, range-reads those, binary-searches inside, and
range-reads the records. The directory of an index file (one row per 3,000
captures) travels with the keys of that file; it is never broadcast as a whole.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, shared_dir

#: Captures in an index block, rows that a task hands on at once, and bytes of an archive.
LINES, CHUNK, ROLL = 3000, 8192, 256_000_000
DATE = "2024-01-01T00:00:00Z"
_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query: ``com,example)/a?b=c``; null gives the empty key."""
    if not url:
        return ""
    try:
        u = urlsplit(url.strip())
        host = (u.hostname or "").lower()
        port = u.port
    except ValueError:
        return url.strip().lower()
    if host.startswith("www."):
        host = host[4:]
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "")
    return f"{key}){u.path or '/'}" + (f"?{u.query}" if u.query else "")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if uri.startswith("/") else uri.replace("file:", "file://", 1))


class _Part:
    """A file written under another name first; its final name holds a complete file or nothing."""

    def __init__(self, folder: str, kind: str):
        self.fs, self.root = _fs(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.name, self.at = f"{uuid.uuid4().hex}{kind}", 0
        self.out = self.fs.open_output_stream(f"{self.root}/.{self.name}.part", compression=None)

    def write(self, data: bytes) -> int:
        """Append; returns where ``data`` starts."""
        at = self.at
        self.out.write(data)
        self.at += len(data)
        return at

    def commit(self) -> None:
        self.out.close()
        self.fs.move(f"{self.root}/.{self.name}.part", f"{self.root}/{self.name}")


def _table(rows: list, names: str, kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names.split())


def record(page_id: int | None, url: str | None, payload: bytes, sha: str, refers: int | None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit that refers to one."""
    kind = "response" if refers is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {json.dumps(url or '')[1:-1]}",
        f"WARC-Payload-Digest: sha1:{sha}",
        f"X-Payload-Length: {len(payload)}",
    ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if refers is None:
        head.append("Content-Type: application/http;msgtype=response")
        body = http + payload
    else:
        head += [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        head.append("Content-Type: application/http;msgtype=response")
        body = http
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's headers and payload; the digest of a response is checked against its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    payload = body.partition(b"\r\n\r\n")[2]
    sha = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and digest(payload) != sha:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    own = fields["WARC-Record-ID"][len("<urn:page:") : -1]
    refers = fields.get("WARC-Refers-To", "")[len("<urn:page:") : -1]
    return {
        "page_id": int(own) if own else None,
        "url": json.loads(f'"{fields["WARC-Target-URI"]}"'),
        "record_type": fields["WARC-Type"],
        "payload_bytes": int(fields["X-Payload-Length"]),
        "payload_digest": sha,
        "refers_to": int(refers) if refers else None,
        "payload": payload,
    }


def _payload_key(html: Column) -> Column:
    return F.unhex(F.sha1(F.encode(html, "utf-8")))


def originals(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``pages`` with ``_first``: the largest page_id among rows of the same payload, null where nothing is shared.

    Only payloads that occur more than once are joined back: minima are
    counted map-side, and both sides of the join are read from storage, so the
    partition of a payload that very many pages share is split.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html")).withColumn("_sha", _payload_key(F.col("html")))
    big = F.octet_length("html") >= least_bytes
    shared = keyed.where(big).groupBy("_sha").agg(F.count("*").alias("n"), F.max("page_id").alias("_first")).where("n > 1").select("_sha", "_first")
    return keyed.join(materialize(shared, "shared"), "_sha", "left").drop("_sha")


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, roll: int = ROLL) -> DataFrame:
    """Write ``pages`` as archives of about ``roll`` bytes in ``folder``; returns the captures ``key, page_id, file, offset, length``."""
    names, kinds = "key page_id file offset length", [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = None, []
        for batch in batches:
            for page_id, url, html, first in zip(*(batch.column(c) for c in ("page_id", "url", "html", "_first")), strict=True):
                part = part or _Part(folder, ".warc.gz")
                page_id, first = page_id.as_py(), first.as_py()
                payload = html.as_py().encode()
                refers = None if first is None or first == page_id else first
                member = gzip.compress(record(page_id, url.as_py(), payload, digest(payload), refers), 6, mtime=0)
                rows.append((url_key(url.as_py()), page_id, part.name, part.write(member), len(member)))
                if part.at >= roll:
                    # rows name an archive only once it is complete
                    part.commit()
                    yield _table(rows, names, kinds)
                    part, rows = None, []
        if rows:
            part.commit()
            yield _table(rows, names, kinds)

    return originals(pages, least_bytes).mapInArrow(run, "key string, page_id long, file string, offset long, length long")


def build_index(captures: DataFrame, folder: str, lines: int = LINES) -> DataFrame:
    """Write the sorted, block-compressed index; returns the directory ``first, last, file, offset, length, n``."""
    names, kinds = "first last file offset length n", [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blocks, held = None, [], []

        def flush() -> None:
            data = zlib.compress("\n".join(json.dumps(r, ensure_ascii=False, separators=(",", ":")) for r in held).encode(), 6)
            blocks.append((held[0][0], held[-1][0], part.name, part.write(data), len(data), len(held)))
            held.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = part or _Part(folder, ".cdx.z")
                held.append(row)
                if len(held) == lines:
                    flush()
        if held:
            flush()
        if blocks:
            part.commit()
            yield _table(blocks, names, kinds)

    # the page id as a second range key: a key that very many captures share still spreads over partitions
    ordered = captures.select("key", "page_id", "file", "offset", "length").repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id", "file", "offset")
    return ordered.mapInArrow(run, "first string, last string, file string, offset long, length long, n long")


class Directory:
    """The sparse first level of the index for one part of the key range."""

    def __init__(self, rows: list[tuple[str, str, str, int, int]], folder: str):
        self.rows, (self.fs, self.root) = sorted(rows), _fs(folder)
        self.firsts, self.lasts = [r[0] for r in self.rows], [r[1] for r in self.rows]
        self.at, self.entries, self.keys = -1, [], []

    def _load(self, i: int) -> None:
        if self.at != i:
            _, _, file, offset, length = self.rows[i]
            with self.fs.open_input_file(f"{self.root}/{file}") as f:
                data = f.read_at(length, offset)
            self.entries = [json.loads(x) for x in zlib.decompress(data).decode().split("\n")]
            self.keys, self.at = [e[0] for e in self.entries], i

    def find(self, key: str) -> Iterator[list]:
        """All captures of ``key``: blocks found by binary search, entries by binary search inside a block."""
        i = bisect.bisect_left(self.lasts, key)
        while i < len(self.rows) and self.firsts[i] <= key:
            self._load(i)
            for e in self.entries[bisect.bisect_left(self.keys, key) : bisect.bisect_right(self.keys, key)]:
                yield e
            i += 1


def lookup(keys: DataFrame, directory: DataFrame, folder: str) -> DataFrame:
    """``key, page_id, file, offset, length`` of every capture of each distinct key of ``keys``.

    Each index file covers one key range. The table of files has a row per
    task that wrote the index (the number of range partitions bounds it), so
    it goes to every task, which finds a key's files by binary search; each
    group of keys then meets its own file's directory.
    """
    files = sorted(tuple(r) for r in directory.groupBy("file").agg(F.min("first").alias("lo"), F.max("last").alias("hi")).select("lo", "hi", "file").collect())
    lows, highs = [f[0] for f in files], [f[1] for f in files]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_file, out_key = [], []
            for key in batch.column("key").to_pylist():
                for i in range(bisect.bisect_left(highs, key), bisect.bisect_right(lows, key)):
                    out_file.append(files[i][2])
                    out_key.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(out_file, pa.string()), pa.array(out_key, pa.string())], names=["file", "key"])

    k = keys.select(F.coalesce("key", F.lit("")).alias("key")).distinct()
    wanted = k.mapInArrow(place, "file string, key string").withColumn("entry", F.lit(None).cast("binary"))
    entry = F.encode(F.to_json(F.struct("first", "last", "file", "offset", "length")), "utf-8")
    rows = directory.select("file", F.lit(None).cast("string").alias("key"), entry.alias("entry")).unionByName(wanted)
    sorted_rows = rows.repartition("file").sortWithinPartitions("file", F.col("key").asc_nulls_first())

    names, kinds = "key page_id file offset length", [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, entries, index = None, [], None
        out: list[list] = []
        for batch in batches:
            for file, key, entry in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != current:
                    current, entries, index = file, [], None
                if entry is not None:
                    e = json.loads(entry)
                    entries.append((e["first"], e["last"], e["file"], e["offset"], e["length"]))
                    continue
                index = index or Directory(entries, folder)
                for found in index.find(key):
                    out.append(found)
                    if len(out) == CHUNK:
                        yield _table(out, names, kinds)
                        out = []
        if out:
            yield _table(out, names, kinds)

    return sorted_rows.mapInArrow(run, "key string, page_id long, file string, offset long, length long")


def read_records(captures: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """Range-read and parse the records at ``file, offset, length``, each archive in order of offset."""
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + (", payload binary" if payload else "")
    names = [x.split(" ")[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[x.split(" ")[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(folder)
        name, handle = None, None
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True)
            out, size = [], 0
            for file, offset, length in rows:
                if file != name:
                    if handle:
                        handle.close()
                    name, handle = file, fs.open_input_file(f"{root}/{file}")
                r = parse(zlib.decompress(handle.read_at(length, offset), 31))
                out.append([r[c] for c in names])
                size += len(r["payload"]) if payload else 100
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
        if handle:
            handle.close()

    # an archive in runs of about 32 MB, so a large one is read by many tasks
    run_of = (F.col("offset") / (1 << 25)).cast("long")
    placed = captures.select("file", "offset", "length", run_of.alias("run")).repartition("file", "run").sortWithinPartitions("file", "offset")
    return placed.mapInArrow(run, schema)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives, index them, and read every page back through the index.

    A null html is an empty payload, a null url the empty key; a null page_id
    is written without a number. Of records with equal payloads all rows with
    the largest page_id are responses (repeated rows repeat), the others
    revisits. Empty tables give empty results. A long payload is one record,
    never cut. Other columns are ignored.
    """
    folder = f"{shared_dir(pages.sparkSession)}/tramline/warc-{uuid.uuid4().hex}"
    captures = materialize(write_archives(pages, folder, least_bytes), "captures")
    directory = materialize(build_index(captures, folder), "directory")
    return read_records(lookup(captures.select("key"), directory, folder), folder)
