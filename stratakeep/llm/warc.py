"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent frames of about FRAME_BYTES before compression; a bundle ends
with the seek table of the public seekable format, a skippable frame that lists each frame's
compressed and plain size. An index maps a record's identifier to its bundle, its frame and its
place inside the plain frame, so one record costs one frame.

Payloads that occur more than once and have at least REVISIT_BYTES are stored once, by the record
with the smallest id; the others are revisit records without payload. Which payloads repeat comes
from a pre-aggregated count of digests, and only those digests are joined back.

Payloads are packed a bounded number of bytes at a time. A record's identifier is made of the page's
id, its archive and its place among the rows of its task, so that rows with repeated or null ids have
identifiers of their own. Bundles are dealt out evenly to as many reading tasks as there are bundles.

Tasks write through the file system of the target URI, each attempt to a name of its own; only
bundles named in the committed index exist to readers, so a task that ran twice leaves no double.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .common import durable, owned, shared_dir, table

# Fixed values of the public seekable Zstandard format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 64 << 20
REVISIT_BYTES = 100
#: Reading tasks at most; with more bundles each task reads several, one after the other.
READERS = 1 << 16
_INDEX = "page_id long, record_id string, file string, frame int, frame_offset long, length long"
_RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload string"


class BundleWriter:
    """Writes frames to an open binary stream and the seek table at its end."""

    def __init__(self, stream):
        self.stream, self.plain, self.frames, self.written = stream, [], [], 0
        self.squeeze = zstandard.ZstdCompressor(level=3)
        self.size = 0

    def add(self, record: bytes) -> tuple[int, int]:
        """Place a record; returns its frame number and its offset in the plain frame."""
        if self.size >= FRAME_BYTES:
            self.flush()
        at = self.size
        self.plain.append(record)
        self.size += len(record)
        return len(self.frames), at

    def flush(self) -> None:
        if self.plain:
            data = self.squeeze.compress(b"".join(self.plain))
            self.stream.write(data)
            self.frames.append((len(data), self.size))
            self.written += len(data)
            self.plain, self.size = [], 0

    def close(self) -> None:
        self.flush()
        entries = b"".join(struct.pack("<II", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer)
        self.stream.close()


class BundleReader:
    """Random access to the frames of one bundle."""

    def __init__(self, uri: str):
        fs, path = pyarrow.fs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC or flags & 0x7C:
            raise ValueError(f"{uri} has no seek table")
        width = 12 if flags & 0x80 else 8
        table_ = self.file.read_at(count * width, size - 9 - count * width)
        self.frames, at = [], 0
        for k in range(count):
            packed, plain = struct.unpack_from("<II", table_, k * width)
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, number: int) -> bytes:
        at, packed, plain = self.frames[number]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=plain)

    def close(self) -> None:
        self.file.close()


def record_id(target: str, page_id: int | None, task: int, row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{target}/page:{page_id}/{task}/{row}')}>"


def _header(value: str) -> str:
    """A url as it may stand in a header line, which control characters must not end."""
    return "".join(f"%{ord(c):02X}" if c < " " or c in "%\x7f" else c for c in value)


def make_record(name: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_to_url: str | None, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {name}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
        if refers_to_url is not None:
            lines += [f"WARC-Refers-To-Target-URI: {_header(refers_to_url)}", f"WARC-Refers-To-Date: {date}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and payload of each record in a plain frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        if first != "WARC/1.1":
            raise ValueError("a record does not begin where the last one ends")
        headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
        begin, size = end + 4, int(headers["content-length"])
        block = data[begin : begin + size]
        yield headers, block[block.index(b"\r\n\r\n") + 4 :]
        at = begin + size + 4


def _row(headers: dict[str, str], payload: bytes, keep: bool) -> tuple:
    kind, number = headers["warc-type"], lambda k: int(headers[k]) if k in headers else None
    digest = headers["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload of {headers['warc-record-id']} does not match its digest")
    url = headers.get("warc-target-uri")
    if url is not None:
        url = re.sub("%(..)", lambda m: chr(int(m[1], 16)), url)
    return number("x-page-id"), url, kind, number("x-refers-to-page"), number("x-payload-length"), digest, payload.decode("utf-8", "replace") if keep and kind == "response" else None


def _write(target: str, date: str):
    def run(batches):
        fs, path = pyarrow.fs.FileSystem.from_uri(target)
        fs.create_dir(path, recursive=True)
        out, rows, task, row = None, [], TaskContext.get().partitionId(), 0
        names = ["page_id", "record_id", "file", "frame", "frame_offset", "length"]
        types = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]

        def packed():
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)

        for batch in tk.pieces(batches, "html"):
            for page, url, html, digest, refers, refers_url in zip(*(batch.column(k).to_pylist() for k in ("page_id", "url", "html", "digest", "refers_to", "refers_to_url"))):
                if out is None:
                    name = f"bundle-{uuid.uuid4().hex}.warc.zst"
                    out = BundleWriter(fs.open_output_stream(f"{path}/{name}", compression=None))
                own = record_id(target, page, task, row)
                row += 1
                record = make_record(own, page, url, (html or "").encode(), digest, refers, refers_url, date)
                frame, at = out.add(record)
                rows.append((page, own, f"{target}/{name}", frame, at, len(record)))
                if out.written >= BUNDLE_BYTES:
                    out.close()
                    out = None
                if len(rows) >= 10000:
                    yield packed()
                    rows.clear()
        if out is not None:
            out.close()
        if rows:
            yield packed()

    return run


def write_archives(pages: DataFrame, target: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row of (page_id, url, html) under ``target``; returns the index.

    Null html is an empty payload and null url no target header. A null id makes a record that no
    revisit refers to. Rows that repeat the smallest id of their payload are stored as responses
    each. Every row has one record, under an identifier of its own, and one index row (page_id, record_id,
    file, frame, frame_offset, length). A payload larger than a frame is a frame, whole. All records have
    the one ``date``. No rows write no bundle. Other columns are not read.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")).withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256))
    long = pages.where(F.octet_length("html") >= REVISIT_BYTES)
    least = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
    again = long.groupBy(F.col("digest").alias("_d")).agg(least.alias("first"), F.count("*").alias("_n")).where("_n > 1 and first is not null")
    again = durable(again.select("_d", F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url")), "payloads")
    rows = pages.join(again, F.col("digest") == F.col("_d"), "left")
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.select("page_id", "url", "html", "digest", F.when(other, F.col("first")).alias("refers_to"), F.when(other, F.col("first_url")).alias("refers_to_url"))
    return durable(rows.mapInArrow(_write(target.rstrip("/"), date), _INDEX), "warc-index")


def _columns(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    cols = list(zip(*rows)) if rows else [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])


def _read(keep: bool):
    def run(batches):
        for batch in batches:
            for uri in batch.column("file").to_pylist():
                bundle = BundleReader(uri)
                for k in range(len(bundle.frames)):
                    yield _columns([_row(h, p, keep) for h, p in parse_records(bundle.frame(k))])
                bundle.close()

    return run


def read_archives(index: DataFrame, payload: bool = True) -> DataFrame:
    """All records of the bundles that an index names; payloads are checked against their digests.

    An empty index has none. A bundle is read by one task, a frame at a time.
    """
    files = durable(index.select("file").distinct(), "bundles")
    # dealt out in turn to a given number of tasks, which Spark does not merge again however short the names are
    return files.repartition(max(1, min(READERS, files.count()))).mapInArrow(_read(payload), _RECORD)


def _fetch(batches):
    for batch in batches:
        opened: dict[str, BundleReader] = {}
        last, data = None, b""
        for file, frame, at, length in sorted(zip(*(batch.column(k).to_pylist() for k in ("file", "frame", "frame_offset", "length")))):
            if (file, frame) != last:
                if file not in opened:
                    for x in opened.values():
                        x.close()
                    opened = {file: BundleReader(file)}
                last, data = (file, frame), opened[file].frame(frame)
            yield _columns([_row(h, p, True) for h, p in parse_records(data[at : at + length])])


def fetch_records(index: DataFrame, ids: DataFrame) -> DataFrame:
    """Records of the wanted page_ids only, each through its frame."""
    return index.join(ids.select("page_id").distinct(), "page_id", "left_semi").mapInArrow(_fetch, _RECORD)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = owned(spark, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    index = write_archives(table(spark, sf_dir, "pages"), target)
    return read_archives(index, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
with p as (
  select page_id, coalesce(html, '') as h from pages
), d as (
  select page_id, strlen(h)::bigint as payload_bytes, sha256(h) as payload_digest from p
), f as (
  select payload_digest, min(page_id) as first from d where payload_bytes >= 100 group by payload_digest
)
select d.page_id, d.payload_bytes, d.payload_digest, case when first is null or first = page_id then 'response' else 'revisit' end as record_type,
  case when first <> page_id then first end as refers_to
from d left join f using (payload_digest)
"""
