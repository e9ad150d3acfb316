"""WARC records in ZIP archives, read by range without extraction.

An archive is a ZIP file with two stored (not compressed) members:
``archive/data.warc.gz``, one gzip member per record, and ``indexes/index.cdxj``, a line per
record with its offset and length. The reader parses the end record, the ZIP64 end
record where there is one, and the central directory; it then reads the index and each record
by its byte range. Files are reached through pyarrow's file systems, so archives can be on any
store that executors share.

Of records with equal payloads of ``min_revisit_bytes`` or more, that with the smallest page_id
is a response and the others are revisit records without a payload.

Defined cases: null html is an empty payload, null url has no target header. A null
page_id never is the one that others revisit unless all are null; then all are responses.
Repeated rows of the smallest page_id are all responses. Columns but
page_id, url and html aren't archived, whatever their names. A very long page is one record, held by one
task as it is written and read. Empty tables give no archives and an empty result.
"""

from __future__ import annotations

import gzip
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import written

MIN_REVISIT_BYTES = 100
#: An archive is closed once its record member has this size.
ARCHIVE_BYTES = 256 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
GZIP_LEVEL = 6
#: Tasks that read archives back; more archives than these share tasks.
MAX_READ_TASKS = 50_000
DATE = "1970-01-01T00:00:00Z"  # the tables hold no capture time; a fixed date keeps reruns equal


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


# records


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head, Content-Length included, and no body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """A record's fields; payload is None for a revisit."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = next(int(h.split(b":")[1]) for h in http.split(b"\r\n") if h.lower().startswith(b"content-length"))
    page = lambda uri: None if uri[10:-1] == "null" else int(uri[10:-1])  # noqa: E731  <urn:page:N>
    revisit = fields["WARC-Type"] == "revisit"
    return {
        "page_id": page(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "payload_bytes": length,
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"),
        "refers_to": page(fields["WARC-Refers-To"]) if revisit else None,
        "payload": None if revisit else payload,
    }


# archives


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int  # where its local header is


class ZipRanges:
    """The members of a ZIP file, from its directories, and byte ranges of stored ones."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size = file, file.size()
        self.members = {m.name: m for m in self._directory()}

    def read(self, at: int, length: int) -> bytes:
        self.file.seek(at)
        return self.file.read(length)

    def _directory(self) -> Iterator[Member]:
        tail_at = max(0, self.size - 65_557)  # the end record and the longest comment
        tail = self.read(tail_at, self.size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("no end of central directory")
        count, length, at = struct.unpack("<HLL", tail[end + 10 : end + 20])
        locator = tail_at + end - 20
        if locator >= 0 and (found := self.read(locator, 20))[:4] == b"PK\x06\x07":
            record64 = self.read(struct.unpack("<Q", found[8:16])[0], 56)
            if record64[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record")
            count, length, at = struct.unpack("<QQQ", record64[32:56])
        directory, here = self.read(at, length), 0
        for _ in range(count):
            if directory[here : here + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            flags, method = struct.unpack("<HH", directory[here + 8 : here + 12])
            packed, size, n_name, n_extra, n_comment = struct.unpack("<LLHHH", directory[here + 20 : here + 34])
            header = struct.unpack("<L", directory[here + 42 : here + 46])[0]
            name = directory[here + 46 : here + 46 + n_name]
            extra = directory[here + 46 + n_name : here + 46 + n_name + n_extra]
            wide = dict(self._extras(extra)).get(1, b"")
            for missing in ("size", "packed", "header"):  # ZIP64 keeps, in this order, those that are all ones
                if {"size": size, "packed": packed, "header": header}[missing] == 0xFFFFFFFF and len(wide) >= 8:
                    value, wide = struct.unpack("<Q", wide[:8])[0], wide[8:]
                    size, packed, header = (value if missing == n else v for n, v in (("size", size), ("packed", packed), ("header", header)))
            yield Member(name.decode("utf-8" if flags & 0x800 else "cp437"), method, packed, header)
            here += 46 + n_name + n_extra + n_comment

    @staticmethod
    def _extras(extra: bytes) -> Iterator[tuple[int, bytes]]:
        while len(extra) >= 4:
            kind, n = struct.unpack("<HH", extra[:4])
            yield kind, extra[4 : 4 + n]
            extra = extra[4 + n :]

    def start(self, name: str) -> int:
        """Where a stored member's bytes begin."""
        member = self.members[name]
        if member.method != 0:
            raise ValueError(f"{name} is compressed; its ranges can't be read")
        head = self.read(member.header, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("broken local header")
        return member.header + 30 + sum(struct.unpack("<HH", head[26:30]))

    def range(self, name: str, offset: int, length: int) -> bytes:
        if offset < 0 or offset + length > self.members[name].size:
            raise ValueError(f"range outside {name}")
        return self.read(self.start(name) + offset, length)


class ArchiveWriter:
    """Writes one archive under a draft name and moves it to its own when it is whole."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.fs, self.path, self.draft = fs, path, f"{path}.draft"
        self.sink = fs.open_output_stream(self.draft)
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.index, self.bytes = [], 0

    def add(self, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> None:
        packed = gzip.compress(record(page_id, url, payload, sha256(payload).hexdigest(), refers_to), GZIP_LEVEL, mtime=0)
        self.data.write(packed)
        self.index.append(json.dumps({"page_id": page_id, "url": url, "offset": self.bytes, "length": len(packed)}))
        self.bytes += len(packed)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(f"{x}\n" for x in self.index))
        self.zip.close()
        self.sink.close()
        self.fs.move(self.draft, self.path)
        return self.path, len(self.index), self.bytes


def revisits(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload (binary) and refers_to, null for responses."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    big = pages.select("page_id", F.sha2(payload, 256).alias("digest"), F.length(payload).alias("bytes")).filter(F.col("bytes") >= min_revisit_bytes)
    firsts = big.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null").select("digest", "first")
    firsts = written(firsts, "equal-payloads")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first"))
    return rows.join(firsts, "digest", "left").select("page_id", "url", "payload", refers.alias("refers_to"))


def write_archives(pages: DataFrame, root: str, archive_bytes: int = ARCHIVE_BYTES, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write archives under root; (path, records, bytes) of each.

    A task's archives have names of their own, and only those of the attempt that
    Spark accepted are in the result, so a lost executor leaves no doubles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = open_fs(root)
        fs.create_dir(folder, recursive=True)
        writer, done = None, []
        for batch in batches:
            ids, urls, refers = (batch.column(c).to_pylist() for c in ("page_id", "url", "refers_to"))
            for i, payload in enumerate(batch.column("payload")):
                writer = writer or ArchiveWriter(fs, f"{folder}/{uuid.uuid4().hex}.zip")
                writer.add(ids[i], urls[i], payload.as_py(), refers[i])
                if writer.bytes >= archive_bytes:
                    done.append(writer.close())
                    writer = None
        if writer:
            done.append(writer.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    return written(revisits(pages, min_revisit_bytes).mapInArrow(run, "path string, records long, bytes long"), "archives")


RECORDS = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
)


def read_archives(archives: DataFrame, root: str, payload: bool = True, batch_bytes: int = 8 << 20) -> DataFrame:
    """The records of archives (rows with path): each checked against its digest.

    payload: whether to return the bytes, null for revisits; they are read and checked all the same.
    """
    schema = RECORDS if payload else RECORDS.remove(6)

    def records(path: str) -> Iterator[dict]:
        fs, _ = open_fs(root)
        with fs.open_input_file(path) as file:
            archive = ZipRanges(file)
            begin = archive.start(DATA)
            index = archive.range(INDEX, 0, archive.members[INDEX].size)
            for line in index.splitlines():
                entry = json.loads(line)
                if entry["offset"] + entry["length"] > archive.members[DATA].size:
                    raise ValueError(f"{path}: the index points outside {DATA}")
                found = parse_record(zlib.decompress(archive.read(begin + entry["offset"], entry["length"]), 31))
                if found["payload"] is not None and (sha256(found["payload"]).hexdigest(), len(found["payload"])) != (found["payload_digest"], found["payload_bytes"]):
                    raise ValueError(f"{path}: record {found['page_id']} does not match its digest")
                yield found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                for r in records(path):
                    rows.append(r if payload else {k: v for k, v in r.items() if k != "payload"})
                    size += 200 + (len(r["payload"] or b"") if payload else 0)
                    if size >= batch_bytes:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    kinds = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + (", payload binary" if payload else "")
    # each archive is a task's work: paths are dealt out one by one, into as many tasks as there are
    # archives (a plain repartition by path would be joined into one task, as paths have few bytes)
    tasks = max(1, min(archives.count(), MAX_READ_TASKS))
    return archives.select("path").repartition(tasks).mapInArrow(run, kinds)
