"""WARC records in ZIP archives: writer, and a reader that range-reads stored records without extracting members."""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, pick, pieces, shared_dir, stored

#: Payloads of fewer bytes are always stored in full.
REVISIT_BYTES = 100
#: Records' bytes that one range read fetches; a longer record is fetched alone.
READ_BYTES = 8 << 20
DATA_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def file_of(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri) if ":" in uri else f"file://{uri}")


# --- records


def record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False, digest: str | None = None) -> bytes:
    """One WARC/1.1 record. A revisit has the payload's digest and length, and no payload. Control characters in the URL are percent-encoded."""
    digest = digest or hashlib.sha256(payload).hexdigest()
    block = _HTTP if revisit else _HTTP + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}",
        *([f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if revisit else []),
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Parsed(NamedTuple):
    page_id: str | None
    url: str | None
    record_type: str
    refers_to: str | None
    payload: bytes | None
    payload_bytes: int
    payload_digest: str


def parse_record(data: bytes) -> Parsed:
    """The record at the start of data; a response's payload must have the digest and length that its header names."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    name = lambda x: (fields[x][1:-1].rpartition(":")[2] or None) if x in fields else None
    block = rest[: int(fields["content-length"])]
    digest, kind = fields["warc-payload-digest"].partition(":")[2], fields["warc-type"]
    payload, size = None, int(fields["x-payload-length"])
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"damaged record {fields['warc-record-id']}")
    return Parsed(name("warc-record-id"), fields.get("warc-target-uri"), kind, name("warc-refers-to"), payload, size, digest)


# --- ZIP directories


class Member(NamedTuple):
    name: str
    method: int
    size: int
    header: int


def _read(f, start: int, length: int) -> bytes:
    f.seek(start)
    data = f.read(length)
    if len(data) != length:
        raise ValueError("the archive ends early")
    return data


def central_directory(f, size: int) -> list[Member]:
    """Members by the central directory, with ZIP64 sizes, counts and offsets where 16- or 32-bit fields are full."""
    tail_at = max(0, size - 65_557)
    tail = _read(f, tail_at, size - tail_at)
    at = tail.rfind(b"PK\5\6")
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(b"PK\5\6", 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    end = tail_at + at
    if end >= 20 and (locator := _read(f, end - 20, 20))[:4] == b"PK\6\7":
        end64 = _read(f, struct.unpack_from("<Q", locator, 8)[0], 56)
        if end64[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<QQQ", end64, 32)
    directory, p, members = _read(f, start, length), 0, []
    for _ in range(count):
        if directory[p : p + 4] != b"PK\1\2":
            raise ValueError("damaged central directory")
        (method,) = struct.unpack_from("<H", directory, p + 10)
        packed, full, names, extras, comment = struct.unpack_from("<IIHHH", directory, p + 20)
        (header,) = struct.unpack_from("<I", directory, p + 42)
        name, extra = directory[p + 46 : p + 46 + names].decode(), directory[p + 46 + names : p + 46 + names + extras]
        while len(extra) >= 4:
            tag, n = struct.unpack_from("<HH", extra)
            if tag == 1:
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                full = next(wide) if full == 0xFFFFFFFF else full
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            extra = extra[4 + n :]
        members.append(Member(name, method, packed, header))
        p += 46 + names + extras + comment
    return members


def data_start(f, m: Member) -> int:
    """Where a stored member's bytes begin."""
    if m.method:
        raise ValueError(f"{m.name} is compressed in the archive; only stored members can be range-read")
    local = _read(f, m.header, 30)
    if local[:4] != b"PK\3\4":
        raise ValueError(f"no local header of {m.name}")
    return m.header + 30 + sum(struct.unpack_from("<HH", local, 26))


# --- writing


_MANIFEST = pa.schema([("archive", pa.string()), ("records", pa.int64())])


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, n, index, at = f"{folder}/{uuid.uuid4().hex}.zip", 0, [], 0  # a repeated task writes another file; the manifest names one
        fs, local = file_of(path)
        fs.create_dir(local.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(local) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            with z.open(zipfile.ZipInfo(DATA_MEMBER), "w", force_zip64=True) as member:
                for b in pieces(batches, "html"):
                    for r in b.to_pylist():
                        revisit = r["refers_to"] is not None
                        pack = zlib.compressobj(3, wbits=31)
                        data = pack.compress(record(r["page_id"], r["url"], (r["html"] or "").encode(), r["refers_to"], revisit, r["digest"])) + pack.flush()
                        member.write(data)
                        index.append(json.dumps({"offset": at, "length": len(data)}))
                        at, n = at + len(data), n + 1
            with z.open(zipfile.ZipInfo(INDEX_MEMBER), "w", force_zip64=True) as member:
                member.write("\n".join(index).encode())
        yield pa.RecordBatch.from_pylist([{"archive": path, "records": n}], _MANIFEST)

    return run


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write one ZIP archive per task and return the manifest (archive, records), stored beside them.

    pages: page_id, url, html; further columns are ignored. Null html is an empty payload, null ids and urls are kept.
    Of rows with equal payloads of REVISIT_BYTES or more those with the smallest page_id are responses and the others
    revisit it (rows that repeat that id are all responses; null ids revisit any other). An empty table gives archives
    without records. Archives lie in `folder`, by default below spark.checkpoint.dir; the manifest names the archives of
    the tasks that succeeded, so lost executors leave at most unnamed files. Only digests are shuffled; where more than
    BROADCAST_ROWS of them repeat, payloads are too, once, by digest and id, so that no digest's copies meet in a task.
    """
    spark = pages.sparkSession
    folder = folder or shared_dir(spark)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pick(pages, "page_id", "url", "html").withColumn("digest", F.sha2(html.cast("binary"), 256))
    long = F.octet_length(html) >= REVISIT_BYTES
    firsts = stored(rows.filter(long).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select("digest", "first"), "firsts")
    if firsts.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(firsts), "digest", "left")
        refers = F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first"))
    else:
        copies = rows.select("page_id", "digest").join(firsts, "digest").filter(~F.col("page_id").eqNullSafe(F.col("first")))
        copies = stored(copies.select(F.col("page_id").alias("copy"), F.col("digest").alias("of"), "first").distinct(), "copies")
        rows = rows.join(copies, rows.page_id.eqNullSafe(copies.copy) & (rows.digest == copies.of), "left")
        refers = F.col("first")
    out = rows.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), "digest", refers.alias("refers_to"))
    return stored(out.mapInArrow(_write(f"{folder}/archives"), "archive string, records long"), "manifest")


# --- reading


_BLOCK = pa.schema([("archive", pa.string()), ("start", pa.int64()), ("lengths", pa.list_(pa.int64()))])


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of neighbouring records, up to READ_BYTES each, by the archives' directories and indexes."""
    for b in batches:
        for path in b.column(0).to_pylist():
            fs, local = file_of(path)
            with fs.open_input_file(local) as f:
                members = {m.name: m for m in central_directory(f, f.size())}
                base, index = data_start(f, members[DATA_MEMBER]), members[INDEX_MEMBER]
                lines = _read(f, data_start(f, index), index.size).splitlines()
            start, lengths, total = None, [], 0
            for x in map(json.loads, lines):
                if lengths and total + x["length"] > READ_BYTES:
                    yield pa.RecordBatch.from_pylist([{"archive": path, "start": start, "lengths": lengths}], _BLOCK)
                    lengths, total = [], 0
                start = start if lengths else base + x["offset"]
                lengths.append(x["length"])
                total += x["length"]
            if lengths:
                yield pa.RecordBatch.from_pylist([{"archive": path, "start": start, "lengths": lengths}], _BLOCK)


_ROW = [("page_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]


def _fetch(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(_ROW + [("payload", pa.binary())] * with_payload)
        for b in batches:
            for block in b.to_pylist():
                fs, local = file_of(block["archive"])
                with fs.open_input_file(local) as f:
                    data = _read(f, block["start"], sum(block["lengths"]))
                rows, at = [], 0
                for n in block["lengths"]:
                    rows.append(parse_record(zlib.decompress(data[at : at + n], wbits=31))._asdict())
                    at += n
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read_archives(spark: SparkSession, archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """Rows (page_id, url, record_type, refers_to, payload_bytes, payload_digest[, payload]) of every indexed record.

    archives: column archive with URIs that the executors can open (further columns are ignored). The ids are strings
    as the records hold them. A revisit's payload is null; its length and digest are the full payload's. Archives are
    located in one pass, then their blocks are dealt out and range-read, so a large archive is read by many tasks.
    Damaged archives and records raise ValueError.
    """
    tasks = max(1, spark.sparkContext.defaultParallelism)
    blocks = pick(archives, "archive").filter("archive is not null").repartition(tasks).mapInArrow(_locate, "archive string, start long, lengths array<long>")
    kind = "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string" + ", payload binary" * with_payload
    return blocks.repartition(4 * tasks, "archive", "start").mapInArrow(_fetch(with_payload), kind)
