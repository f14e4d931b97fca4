"""WARC archives from legacy ARC files.

An ARC file opens with a ``filedesc`` record whose body names the version and the header fields;
every further record is one header line of that version (five fields in version 1, ten in version 2)
and as many bytes as it declares. The converter parses these and synthesises what WARC asks for:
record identifiers (name-based UUIDs over file and offset), dates, types and payload digests.

Archives lie in the shared folder and are compressed record by record. Tasks write files under names
of their own and return them as rows of a manifest, so files of failed attempts are never read.
Payload digests are grouped over all archives to decide which record is a response and which refer
to it; digests that more than a thousandth of all records share go by a broadcast of at most a
thousand rows, the others by a shuffle join.

Defined results: a null payload is empty; a null URL is written as ``-``; white space in URLs is
percent-encoded; of equal payloads the largest page id, nulls last, is the response, and of rows
that repeat it the last in archive order; repeated rows are records of their own; extra columns are
ignored; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_spread, only, raw_texts, shared_path, sliced, written

V1 = b"URL IP-address Archive-date Content-type Archive-length"
V2 = b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
DATE = "20200101000000"
LEVEL = 1
ROLL = 64 << 20


class ArchiveError(ValueError):
    """Bytes that are no archive of a known version."""


# == compressed members ==


def pack_member(raw: bytes, level: int = LEVEL) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def members(stream: io.RawIOBase, chunk: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member; memory holds one member."""
    at, rest = 0, b""
    while True:
        z, parts, start = zlib.decompressobj(31), [], at
        if not rest:
            rest = stream.read(chunk)
            if not rest:
                return
        while True:
            parts.append(z.decompress(rest))
            at += len(rest) - len(z.unused_data)
            rest = z.unused_data
            if z.eof:
                break
            rest = stream.read(chunk)
            if not rest:
                raise ArchiveError("the last member is cut off")
        yield start, at - start, b"".join(parts)


# == ARC ==


@dataclass
class ArcRecord:
    url: bytes
    ip: bytes
    date: str
    mime: bytes
    body: bytes
    extra: dict[str, bytes] = field(default_factory=dict)


def _plain(url: bytes) -> bytes:
    return b"".join(b"%%%02X" % c if c <= 32 or c == 127 else bytes((c,)) for c in url) if any(c <= 32 or c == 127 for c in url) else url


def arc_header(version: int, name: str, date: str = DATE) -> bytes:
    """The record that opens an ARC file."""
    body = b"%d 0 plumbline\n%s\n" % (version, V1 if version == 1 else V2)
    if version == 1:
        line = b"filedesc://%s 0.0.0.0 %s text/plain %d\n" % (name.encode(), date.encode(), len(body))
    else:
        line = b"filedesc://%s 0.0.0.0 %s text/plain 200 - - 0 %s %d\n" % (name.encode(), date.encode(), name.encode(), len(body))
    return line + body + b"\n"


def arc_record(version: int, record: ArcRecord, offset: int, name: str) -> bytes:
    url = _plain(record.url or b"-")
    if version == 1:
        line = b"%s %s %s %s %d\n" % (url, record.ip, record.date.encode(), record.mime, len(record.body))
    else:
        line = b"%s %s %s %s 200 - - %d %s %d\n" % (url, record.ip, record.date.encode(), record.mime, offset, name.encode(), len(record.body))
    return line + record.body + b"\n"


def arc_version(raw: bytes) -> int:
    """The version that an ARC file's opening record declares."""
    line, _, body = raw.lstrip(b"\n").partition(b"\n")
    if not line.startswith(b"filedesc://"):
        raise ArchiveError("no filedesc record")
    first, _, rest = body.partition(b"\n")
    fields = rest.partition(b"\n")[0].strip()
    version = first.split(b" ")[0]
    if version == b"1" and len(fields.split()) == 5:
        return 1
    if version == b"2" and len(fields.split()) == 10:
        return 2
    raise ArchiveError(f"unknown version {first!r} with fields {fields!r}")


def parse_arc(raw: bytes, version: int) -> ArcRecord:
    """One record under its file's version; the declared length must be there."""
    line, _, rest = raw.lstrip(b"\n").partition(b"\n")
    parts = line.rsplit(b" ", 4 if version == 1 else 9)
    if len(parts) != (5 if version == 1 else 10):
        raise ArchiveError(f"bad header line {line[:200]!r}")
    size = int(parts[-1])
    if len(rest) < size:
        raise ArchiveError(f"{size} bytes are declared, {len(rest)} are there")
    url, ip, date, mime = parts[:4]
    extra = dict(zip(("result", "checksum", "location", "offset", "filename"), parts[4:-1]))
    return ArcRecord(url, ip, date.decode(), mime, rest[:size], extra)


def split_http(body: bytes) -> tuple[dict[bytes, bytes], bytes, bytes]:
    """(headers by lower-case name, raw head with its blank line, payload)."""
    head, gap, payload = body.partition(b"\r\n\r\n")
    headers = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        headers[k.strip().lower()] = v.strip()
    return headers, head + gap, payload


# == WARC ==


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_date(arc_date: str) -> str:
    d = (arc_date + "0" * 14)[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(archive: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{archive}#{offset}')}>"


def warc_record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_warc(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ArchiveError("no WARC record")
    fields = {}
    for line in lines[1:]:
        k, _, v = line.partition(":")
        fields[k.strip().lower()] = v.strip()
    size = int(fields["content-length"])
    if len(rest) < size:
        raise ArchiveError(f"{size} bytes are declared, {len(rest)} are there")
    return fields, rest[:size]


# == jobs ==


class _Roller:
    """Writes members into files of bounded size below a folder; ``done`` lists finished files."""

    def __init__(self, folder: str, suffix: str, opening) -> None:
        self.system, self.folder = fs.FileSystem.from_uri(folder)
        self.system.create_dir(self.folder, recursive=True)
        self.suffix, self.opening, self.out, self.done = suffix, opening, None, []
        self.stem = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}"

    def add(self, make) -> None:
        """``make(offset, name)`` gives a record's bytes."""
        if self.out is None:
            self.name = f"{self.stem}-{len(self.done):04d}{self.suffix}"
            self.out, self.at = self.system.open_output_stream(f"{self.folder}/{self.name}", compression=None), 0
            self._write(self.opening(self.name))
        self._write(make(self.at, self.name))
        if self.at >= ROLL:
            self.close()

    def _write(self, raw: bytes) -> None:
        member = pack_member(raw)
        self.out.write(member)
        self.at += len(member)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append(self.name)
            self.out = None


def _read(folder: str, name: str) -> Iterator[tuple[int, int, bytes]]:
    system, path = fs.FileSystem.from_uri(folder)
    with system.open_input_stream(f"{path}/{name}", compression=None) as f:
        yield from members(f)


def _file_tasks(rows: DataFrame, files: int) -> DataFrame:
    """Rows of one archive in one task, and few archives in a task; their metadata are too small to tell."""
    return rows.repartition(max(1, min(4 * files, 40_000)), "name")


def _page_field(page: str | None) -> bytes:
    return b"" if page is None else b"X-Page-Id: %s\r\n" % quote(page, safe="").encode()


def _page_of(field: bytes | str | None) -> str | None:
    return None if field is None else unquote(field.decode() if isinstance(field, bytes) else field)


def write_arcs(pages: DataFrame, folder: str) -> DataFrame:
    """Write legacy archives of ``page_id``, ``url``, ``html``, versions by turns; their manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version = 1 + TaskContext.get().partitionId() % 2
        roller = _Roller(folder, ".arc.gz", lambda name: arc_header(version, name))
        for batch in sliced(batches, "html", 8 << 20):
            for page, url, html in zip(batch.column("page_id").to_pylist(), raw_texts(batch.column("url")), raw_texts(batch.column("html"))):
                payload = html or b""
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n%sContent-Length: %d\r\n\r\n" % (_page_field(page), len(payload))
                record = ArcRecord(url or b"-", b"0.0.0.0", DATE, b"text/html", head + payload)
                roller.add(lambda at, name: arc_record(version, record, at, name))  # noqa: B023
        roller.close()
        yield pa.RecordBatch.from_arrays([pa.array(roller.done, pa.string())], names=["name"])

    slim = only(pages, "page_id", "url", "html").withColumn("page_id", F.col("page_id").cast("string"))
    return written(slim.mapInArrow(run, "name string"), "arc-manifest")


def index_arcs(manifest: DataFrame, folder: str, kind: str = "bigint") -> DataFrame:
    """Parse legacy archives: a row per record with its place, page of type ``kind``, payload length and digest."""
    schema = "name string, offset bigint, page_id string, payload_bytes bigint, payload_digest string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows, version = [], None
                for offset, _, raw in _read(folder, name):
                    if version is None:
                        version = arc_version(raw)
                        continue
                    headers, _, payload = split_http(parse_arc(raw, version).body)
                    rows.append((name, offset, _page_of(headers.get(b"x-page-id")), len(payload), digest(payload)))
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
                columns = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["name", "offset", "page_id", "payload_bytes", "payload_digest"])

    found = _file_tasks(manifest, manifest.count()).mapInArrow(run, schema)
    return written(found.withColumn("page_id", F.col("page_id").cast(kind)), "arc-index")


def choose_responses(index: DataFrame, least: int = 0) -> DataFrame:
    """``index`` with ``first``: the response that a record's payload is written with.

    Records with payloads under ``least`` bytes are all responses of their own.
    """
    rank = F.struct(F.col("page_id").isNotNull().alias("named"), "page_id", "name", "offset")
    shared = index.where(F.col("payload_bytes") >= least)
    groups = written(shared.groupBy("payload_digest").agg(F.max(rank).alias("first"), F.count("*").alias("n")), "payload-groups")
    total = index.count()
    many = groups.where("n > 1").select("payload_digest", F.col("first").alias("found"), "n")
    joined = join_spread(index, many, "payload_digest", total, "left")
    found = F.when(F.col("payload_bytes") >= least, F.col("found"))
    return joined.withColumn("first", F.when((found["name"] == F.col("name")) & (found["offset"] == F.col("offset")), None).otherwise(found)).drop("found")


def write_warcs(records: DataFrame, arcs: str, folder: str, files: int) -> DataFrame:
    """Convert legacy records to WARC files, a file's records in one task; their manifest."""
    slim = records.select("name", "offset", "payload_digest", F.col("first.name").alias("to_name"), F.col("first.offset").alias("to_offset"), F.col("first.page_id").cast("string").alias("to_page"))
    slim = _file_tasks(slim, files).sortWithinPartitions("name", "offset")

    def info(name: str) -> bytes:
        return warc_record("warcinfo", [("WARC-Record-ID", record_id(name, -1)), ("WARC-Date", warc_date(DATE)), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"software: plumbline\r\nformat: WARC File Format 1.1\r\n")

    def convert(name: str, row: dict, record: ArcRecord) -> bytes:
        _, head, payload = split_http(record.body)
        fields = [
            ("WARC-Record-ID", record_id(name, row["offset"])), ("WARC-Date", warc_date(record.date)), ("WARC-Target-URI", record.url.decode()),
            ("WARC-IP-Address", record.ip.decode()), ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"), ("Content-Type", "application/http; msgtype=response"),
        ]
        if row["to_name"] is None:
            return warc_record("response", fields, head + payload)
        page = [] if row["to_page"] is None else [("X-Refers-To-Page", quote(row["to_page"], safe=""))]
        fields += [("WARC-Refers-To", record_id(row["to_name"], row["to_offset"])), *page, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        return warc_record("revisit", fields, head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = _Roller(folder, ".warc.gz", info)
        name, stream, version = None, iter(()), 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["name"] != name:
                    name = row["name"]
                    stream = _read(arcs, name)
                    version = arc_version(next(stream)[2])
                raw = next(raw for offset, _, raw in stream if offset == row["offset"])
                member = convert(name, row, parse_arc(raw, version))
                roller.add(lambda at, file: member)  # noqa: B023
        roller.close()
        yield pa.RecordBatch.from_arrays([pa.array(roller.done, pa.string())], names=["name"])

    return written(slim.mapInArrow(run, "name string"), "warc-manifest")


def read_warcs(manifest: DataFrame, folder: str, kind: str = "bigint") -> DataFrame:
    """Read WARC files: page, payload length and digest, type and the page of the response."""
    schema = "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows = []
                for _, _, raw in _read(folder, name):
                    fields, block = parse_warc(raw)
                    if fields["warc-type"] == "warcinfo":
                        continue
                    headers, _, payload = split_http(block)
                    stated = fields["warc-payload-digest"].removeprefix("sha1:")
                    size = int(headers[b"content-length"])
                    if fields["warc-type"] == "response" and (len(payload) != size or digest(payload) != stated):
                        raise ArchiveError(f"{fields['warc-record-id']}: the payload is not the one described")
                    rows.append((_page_of(headers.get(b"x-page-id")), size, stated, fields["warc-type"], _page_of(fields.get("x-refers-to-page"))))
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
                columns = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split(" ")[0] for f in schema.split(", ")])

    found = _file_tasks(manifest, manifest.count()).mapInArrow(run, schema)
    return found.select(*[F.col(c).cast(kind).alias(c) if c in ("page_id", "refers_to") else c for c in found.columns])


def archive_pages(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write pages as legacy archives, convert them to WARC and read the result back."""
    spark = pages.sparkSession
    arcs, warcs = shared_path(spark, "arcs"), shared_path(spark, "warcs")
    kind = only(pages, "page_id").schema[0].dataType.simpleString()
    made = write_arcs(pages, arcs)
    index = index_arcs(made, arcs, kind)
    return read_warcs(write_warcs(choose_responses(index, least), arcs, warcs, made.count()), warcs, kind)
