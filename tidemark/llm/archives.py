"""WARC archives compressed with Zstandard: writer and reader.

An archive starts with a skippable frame (0x184D2A5D) that holds a dictionary; each
record is one frame compressed with it. The reader loads the dictionary, decodes
one frame for each record, and checks the record's version line, its required
headers, its declared block length, its two final line breaks, and its payload's
length and digest; a failed check is an error that names the archive and record.

Pages with equal payloads have one response, that with the smallest page_id; the
others are revisit records, which carry the HTTP headers (with the payload's full
length) but no payload. Only payloads found more than once take part in a join, and
their first ids are a table of digests, written so that a hot digest can be split.

Each writing task fills archives of about `ARCHIVE_BYTES` in the shared folder, with
a dictionary trained on its first records (`SAMPLE_BYTES` of them, or one record, if
that is larger; the first 64 KiB of each). Where those are too few or too equal to
train on, their own bytes are the dictionary, so every archive has one. A manifest
table names the archives of the tasks that ended well, so a task that ran twice adds
nothing; the reader deals the archives out to tasks of about `ARCHIVE_BYTES`.

Defined cases: null html has an empty payload. Rows that share the payload's
smallest page_id are all responses. A null page_id sorts last; if all are null, all
are responses. An empty table gives no records. Repeated rows each get a record. Very
long pages are one record each. Line breaks in a URL are percent-encoded. Other
columns are ignored, whatever their names."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import new_path, stored

MAGIC, LEVEL = 0x184D2A5D, 3
ARCHIVE_BYTES, SAMPLE_BYTES, SAMPLE_RECORDS, DICTIONARY_BYTES = 64 << 20, 1 << 20, 300, 16 << 10
_READ = 1 << 20


class WarcError(ValueError):
    """An archive that breaks the format."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uuid(page_id: int | None) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_OID, f"page:{page_id}"))


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit's block ends with its HTTP headers."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    lines = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{_uuid(page_id)}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha1:{payload_digest}"),
        ("WARC-Page-ID", "" if page_id is None else str(page_id)),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        lines[2:2] = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:uuid:{_uuid(refers_to)}>"), ("WARC-Refers-To-Page-ID", str(refers_to))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _headers(text: bytes, where: str) -> dict[str, str]:
    found = {}
    for line in text.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise WarcError(f"{where}: malformed header {line[:60]!r}")
        found[name.decode().strip().lower()] = value.decode().strip()
    return found


def parsed(data: bytes, where: str = "record") -> dict:
    """The checked contents of one record."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not gap or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError(f"{where}: no WARC version and header")
    h = _headers(lines, where)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"):
        if name not in h:
            raise WarcError(f"{where}: {name} is missing")
    if not h["content-length"].isdigit() or len(rest) != int(h["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError(f"{where}: block of {len(rest) - 4} bytes, {h['content-length']} declared")
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    status, _, lines = http.partition(b"\r\n")
    if not gap or not status.startswith(b"HTTP/"):
        raise WarcError(f"{where}: no HTTP header")
    n, kind = _headers(lines, where).get("content-length", ""), h["warc-type"]
    if not n.isdigit() or kind not in ("response", "revisit"):
        raise WarcError(f"{where}: type {kind!r}, payload length {n!r}")
    said = h["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != int(n) or digest(payload) != said):
        raise WarcError(f"{where}: the payload differs from its length or digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in h):
        raise WarcError(f"{where}: a revisit with a payload or without its response")
    number = lambda k: int(h[k]) if h.get(k) else None
    return {
        "page_id": number("warc-page-id"),
        "url": h.get("warc-target-uri"),
        "payload_bytes": int(n),
        "payload_digest": said,
        "record_type": kind,
        "refers_to": number("warc-refers-to-page-id"),
        "payload": payload if kind == "response" else None,
    }


def read_archive(stream: BinaryIO, where: str = "archive") -> Iterator[dict]:
    """The records of one archive, a frame at a time."""
    head = stream.read(8)
    if len(head) < 8:
        raise WarcError(f"{where}: shorter than a frame's head")
    magic, size = struct.unpack("<II", head)
    if magic != MAGIC:
        raise WarcError(f"{where}: it doesn't start with a dictionary frame")
    raw = stream.read(size)
    if len(raw) != size:
        raise WarcError(f"{where}: the dictionary is cut off")
    if raw[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary may be compressed itself
        raw = zstandard.ZstdDecompressor().decompress(raw)
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    buffer, k = b"", 0
    while buffer or (buffer := stream.read(_READ)):
        one, parts = decoder.decompressobj(), []
        while True:
            try:
                parts.append(one.decompress(buffer))
            except zstandard.ZstdError as e:
                raise WarcError(f"{where}, record {k}: {e}") from e
            if one.eof:
                buffer = one.unused_data
                break
            if not (buffer := stream.read(_READ)):
                raise WarcError(f"{where}, record {k}: the frame is cut off")
        yield parsed(b"".join(parts), f"{where}, record {k}")
        k += 1


class Writer:
    """One archive at a time in a folder; its dictionary comes from its first records."""

    def __init__(self, folder: str, name: str) -> None:
        self.fs, self.folder = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.name, self.waiting, self.waits, self.out, self.done, self.n, self.size = name, [], 0, None, [], 0, 0

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.waiting.append(data)
            self.waits += len(data)
            if len(self.waiting) >= SAMPLE_RECORDS or self.waits >= SAMPLE_BYTES:
                self._begin()
        else:
            self._put(data)
        if self.out is not None and self.size >= ARCHIVE_BYTES:
            self._end()

    def _begin(self) -> None:
        samples = [w[: 64 << 10] for w in self.waiting]
        try:
            raw = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=200, d=8).as_bytes()
        except zstandard.ZstdError:  # too few or too equal samples
            raw = b"".join(samples)[:DICTIONARY_BYTES]
        self.path = f"{self.folder}/{self.name}-{len(self.done):05d}.warc.zst"
        self.out = self.fs.open_output_stream(self.path, compression=None)  # the name's ending must not compress it again
        self.coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None, write_content_size=True)
        self.out.write(struct.pack("<II", MAGIC, len(raw)) + raw)
        self.n, self.size = 0, 8 + len(raw)
        waiting, self.waiting, self.waits = self.waiting, [], 0
        for w in waiting:
            self._put(w)

    def _put(self, data: bytes) -> None:
        frame = self.coder.compress(data)
        self.out.write(frame)
        self.n, self.size = self.n + 1, self.size + len(frame)

    def _end(self) -> None:
        self.out.close()
        self.done.append((self.path, self.n, self.size))
        self.out = None

    def close(self) -> list[tuple[str, int, int]]:
        if self.waiting:
            self._begin()
        if self.out is not None:
            self._end()
        return self.done


def written(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes archives below `folder` (a URI; by default in the shared folder) and
    returns their manifest: path, records, bytes."""
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", html.alias("payload")).withColumn("sha", F.sha1("payload"))
    firsts = pages.select("page_id", F.sha1(html).alias("sha")).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = stored(firsts.filter("n > 1 AND first IS NOT NULL").select(F.col("sha").alias("_sha"), "first"), "copies")
    rows = rows.join(firsts, F.col("sha") == F.col("_sha"), "left").select("page_id", "url", "payload", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = Writer(folder, uuid.uuid4().hex)
        for batch in batches:
            for page_id, url, payload, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "first")), strict=True):
                revisit = first is not None and first != page_id
                writer.add(record(page_id, url, payload, digest(payload), first if revisit else None, revisit))
        done = writer.close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["path", "records", "bytes"])

    manifest = rows.mapInArrow(run, "path string, records long, bytes long").withColumn("root", F.lit(folder))
    return stored(manifest, "manifest")


def records(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """The archives' records, checked: page_id, payload_bytes, payload_digest,
    record_type, refers_to, url, and with `payloads` the payload (null for revisits)."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"] + ["payload"] * payloads
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()][: len(names)]
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for root, path, n in zip(*(batch.column(c).to_pylist() for c in ("root", "path", "records")), strict=True):
                store, _ = fs.FileSystem.from_uri(root)
                rows, read = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for r in read_archive(stream, path):
                        rows.append(tuple(r[c] for c in names))
                        read += 1
                        if len(rows) >= 500:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows = []
                if read != n:
                    raise WarcError(f"{path}: {read} records, {n} written")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    n, size = manifest.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks = max(1, min(n, max(manifest.sparkSession.sparkContext.defaultParallelism, -(-size // ARCHIVE_BYTES))))
    # a number of its own, as the manifest's few bytes would be read by one task
    return manifest.repartition(tasks).mapInArrow(run, schema)
