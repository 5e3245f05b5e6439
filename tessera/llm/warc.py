"""WARC archives with a two-level capture index.

Archives: gzip members, one a record. A capture whose payload (of at least ``min_bytes``) also has a capture with a
larger page_id is a ``revisit`` that names the one with the largest; all others are ``response``. A revisit keeps its
HTTP header, and so the payload's length, but no payload.

Index: captures sorted by reversed-host key and page_id over index files. A file is a row of zlib blocks of BLOCK
lines, then its sparse directory (first key of each block, offset, length), then a tail that says where that is. The
list of files with their first keys is the level above. A lookup bisects the list, the directory and the block's
lines, and reads the directory, the block and the record by ranges.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import struct
import urllib.parse
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import new_path, partitions, written
from tessera.llm.files import NewFile, Ranges

MIN_BYTES = 1000
BLOCK = 1024
TAIL = struct.Struct("<QQ4s")
MAGIC = b"CIX2"
DATE = "2000-01-01T00:00:00Z"
#: Captures that a task lists at a time.
LISTED = 10_000
#: Bytes of an archive after which a task begins another; bytes that a reader takes at a time.
FILE_BYTES, SPAN_BYTES = 1 << 30, 8 << 20


def url_key(url: str | None) -> str:
    """The sort key of a URL: its host's labels reversed, then port, path and query; scheme, user and fragment do not
    count. Text without a host is its own key; null is the empty key. Tabs and line feeds are escaped."""
    u = (url or "").strip()
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^#]*)", u)
    if not m:
        return re.sub(r"[\t\r\n]", lambda x: f"%{ord(x[0]):02X}", u)
    host, _, port = m[1].rpartition("@")[2].lower().partition(":")
    if not re.fullmatch(r"[0-9.]+", host):
        host = ",".join(reversed(host.rstrip(".").split(".")))
    return re.sub(r"[\t\r\n]", lambda x: f"%{ord(x[0]):02X}", host + (f":{port}" if port and port not in ("80", "443") else "") + ")" + (m[2] or "/"))


def record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, not yet compressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        "WARC-Type: " + ("response" if refers_to is None else "revisit"),
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {DATE}",
        "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode(),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


@dataclass
class Capture:
    page_id: int
    kind: str
    payload_bytes: int
    digest: str
    refers_to: int | None
    payload: bytes


def parse(raw: bytes) -> Capture:
    """A record's capture; its digests are checked against its bytes."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    field = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[: int(field["Content-Length"])]
    if len(rest) != len(body) + 4 or hashlib.sha1(body).digest() != base64.b32decode(field["WARC-Block-Digest"].partition(":")[2]):
        raise ValueError(f"damaged record {field['WARC-Record-ID']}")
    http, _, payload = body.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = base64.b32decode(field["WARC-Payload-Digest"].partition(":")[2])
    kind = field["WARC-Type"]
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).digest() != digest):
        raise ValueError(f"damaged payload {field['WARC-Record-ID']}")
    number = lambda x: int(x.rpartition(":")[2].rstrip(">"))
    return Capture(number(field["WARC-Record-ID"]), kind, length, digest.hex(), number(field["WARC-Refers-To"]) if kind == "revisit" else None, payload)


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes a record for every page; returns the captures (key, page_id, file, offset, length, kind) as a written table.

    A null html is an empty payload, a null url leaves the target out; rows with a null page_id are left out. Of rows
    with one page_id and one payload all name the same response, and are responses if their id is the largest.
    """
    spark = pages.sparkSession
    rows = pages.where(F.col("page_id").isNotNull()).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    sizes = rows.select("page_id", "digest", F.octet_length("html").alias("size")).where(F.col("size") >= min_bytes)
    kept = sizes.groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1").select("digest", "kept")
    # who refers to whom is settled among ids; payloads are joined by their own id, so that none meets at a frequent digest
    revisits = sizes.join(kept, "digest").where("page_id <> kept").select("page_id", "digest", F.col("kept").alias("refers_to")).distinct()
    dealt = rows.join(written(revisits, "revisits"), ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rows = None, []
        for b in batches:
            for page, url, html, digest, refers in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist()):
                if out and out.size > FILE_BYTES:
                    out.close()
                    out = None
                if not out:
                    out = NewFile(folder, ".warc.gz")
                    info = b"software: tessera\r\n"
                    out.write(gzip.compress(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:file:{out.name}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n", mtime=0))
                raw = gzip.compress(record(page, url, html.as_buffer().to_pybytes(), digest, refers), 4, mtime=0)
                rows.append((url_key(url), page, out.name, out.write(raw), len(raw), "response" if refers is None else "revisit"))
                if len(rows) == LISTED:
                    yield listed(rows)
                    rows = []
        if out:
            out.close()
        if rows:
            yield listed(rows)

    def listed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["key", "page_id", "file", "offset", "length", "kind"])

    return written(dealt.mapInArrow(run, "key string, page_id long, file string, offset long, length long, kind string"), "captures")


def end(out: NewFile, directory: list) -> None:
    raw = zlib.compress(json.dumps(directory).encode())
    at = out.write(raw)
    out.write(TAIL.pack(at, len(raw), MAGIC))
    out.close()


def write_index(captures: DataFrame, folder: str, block: int = BLOCK) -> DataFrame:
    """Writes the index files; returns (file, first_key, first_page), a row for each of them, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, directory, lines, first = None, [], [], None

        def flush() -> None:
            nonlocal lines
            raw = zlib.compress("\n".join(lines).encode("utf-8", "surrogatepass"))
            directory.append((*first, out.write(raw), len(raw)))
            lines = []

        for b in batches:
            for key, page, *rest in zip(*(c.to_pylist() for c in b.columns)):
                out = out or NewFile(folder, ".cix")
                if not lines:
                    first = (key, page)
                lines.append(f"{key}\t{page}\t{json.dumps(rest)}")
                if len(lines) == block:
                    flush()
        if out:
            if lines:
                flush()
            end(out, directory)
            yield pa.RecordBatch.from_arrays([pa.array([out.name]), pa.array([directory[0][0]]), pa.array([directory[0][1]]), pa.array([out.size])], ["file", "first_key", "first_page", "size"])

    cols = ["key", "page_id", "file", "offset", "length", "kind"]
    dealt = captures.select(*cols).repartitionByRange(partitions(captures.sparkSession), "key", "page_id").sortWithinPartitions(*cols)
    return written(dealt.mapInArrow(run, "file string, first_key string, first_page long, size long"), "index-files")


class Index:
    """Looks captures up by bisecting the list of files, a file's directory and a block's lines."""

    def __init__(self, folder: str, files: list[tuple[str, int, str, int]]):
        """files: (first_key, first_page, file, size), sorted."""
        self.ranges, self.files = Ranges(folder), files
        self.directory: tuple[str, list] = ("", [])
        self.block: tuple[str, int, list, list] = ("", -1, [], [])

    def _directory(self, file: str, size: int) -> list:
        if self.directory[0] != file:
            at, n, magic = TAIL.unpack(self.ranges.read(file, size - TAIL.size, TAIL.size))
            if magic != MAGIC:
                raise ValueError(f"{file} is no index file")
            self.directory = (file, json.loads(zlib.decompress(self.ranges.read(file, at, n))))
        return self.directory[1]

    def _block(self, file: str, offset: int, length: int) -> tuple[list, list]:
        if self.block[:2] != (file, offset):
            lines = [x.split("\t") for x in zlib.decompress(self.ranges.read(file, offset, length)).decode("utf-8", "surrogatepass").split("\n")]
            self.block = (file, offset, [(k, int(p)) for k, p, _ in lines], [x[2] for x in lines])
        return self.block[2], self.block[3]

    def find(self, key: str, page: int | None = None) -> Iterator[tuple[str, int, list]]:
        """(key, page_id, [file, offset, length, kind]) of the captures of a key, of one page if it is given."""
        low, high = (key, -(2**63) if page is None else page), (key, 2**63 if page is None else page)
        f = max(0, bisect.bisect_left(self.files, low, key=lambda x: (x[0], x[1])) - 1)
        for first_key, first_page, file, size in self.files[f:]:
            if (first_key, first_page) > high:
                return
            directory = self._directory(file, size)
            d = max(0, bisect.bisect_left(directory, low, key=lambda x: (x[0], x[1])) - 1)
            for k, p, offset, length in directory[d:]:
                if (k, p) > high:
                    return
                keys, rest = self._block(file, offset, length)
                for i in range(bisect.bisect_left(keys, low), bisect.bisect_right(keys, high)):
                    yield *keys[i], json.loads(rest[i])


def lookup(wanted: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """(key, page_id, file, offset, length, kind) of the captures of wanted's rows (key, page_id or null for all of a
    key's), each found through the index. A worker takes its rows in key order, so that it reads every block once."""
    listed = sorted((r.first_key, r.first_page, r.file, r.size) for r in files.collect())  # a row for each index file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(folder, listed)
        for b in batches:
            rows = [(k, p, *rest) for key, page in zip(*(c.to_pylist() for c in b.columns)) for k, p, rest in index.find(key, page)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["key", "page_id", "file", "offset", "length", "kind"])

    dealt = wanted.select("key", "page_id").distinct().repartitionByRange(partitions(wanted.sparkSession), "key", "page_id").sortWithinPartitions("key", "page_id")
    return dealt.mapInArrow(run, "key string, page_id long, file string, offset long, length long, kind string")


def read_records(found: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the captures, read by ranges of the archives
    in file order; neighbouring records are one read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Ranges(folder)
        for b in batches:
            rows, spans = [], []
            for file, offset, length in zip(*(c.to_pylist() for c in b.columns)):
                if spans and spans[-1][0] == file and spans[-1][1] + spans[-1][2] == offset and spans[-1][2] + length <= SPAN_BYTES:
                    spans[-1][2] += length
                    spans[-1][3].append(length)
                else:
                    spans.append([file, offset, length, [length]])
            for file, offset, length, parts in spans:
                raw, at = files.read(file, offset, length), 0
                for n in parts:
                    c = parse(gzip.decompress(raw[at : at + n]))
                    rows.append((c.page_id, c.payload_bytes, c.digest, c.kind, c.refers_to))
                    at += n
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    dealt = found.select("file", "offset", "length").repartition(partitions(found.sparkSession), "file").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def page_keys(pages: DataFrame) -> DataFrame:
    """(key, page_id) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in b.column(0).to_pylist()], pa.string()), b.column(1)], ["key", "page_id"])

    return pages.where(F.col("page_id").isNotNull()).select(F.col("url").cast("string"), F.col("page_id").cast("long").alias("page_id")).mapInArrow(run, "key string, page_id long")


def archive_round_trip(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes archives and index, looks every page up by its URL's key and reads its record back."""
    spark: SparkSession = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    captures = write_archives(pages, folder, min_bytes)
    files = write_index(captures, folder)
    return read_records(lookup(page_keys(pages), files, folder), folder)
