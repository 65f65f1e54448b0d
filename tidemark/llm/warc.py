"""Legacy web archives converted to WARC.

An ARC file begins with a description that names its version; the version says
which fields stand in the header line of each record:

    1   URL IP-address Archive-date Content-type Archive-length
    2   URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length

After the header line come as many bytes as the line declares, then a line feed.
The converter makes an equivalent WARC record of each: an identifier derived from
the record, the date in ISO form, the type by what the bytes hold (an HTTP
response, a DNS answer or another resource), digests of block and payload.

`archive` writes pages as ARC records, converts them, and stores each partition's
records in one compressed WARC file in the shared folder; `read` takes the files
apart again and checks every declared length and digest on the way.

Of equal payloads of at least `LEAST_SHARED` bytes the page with the largest id
has the response; the others are revisits that refer to it and hold no payload.

Payloads are equal when their SHA-256 and size are; SHA-1 is what the digest field
of a record has.

Defined results: a null page counts as empty; a null or empty URL is written as
`UNKNOWN_URL`, white space in URLs is percent-encoded; a null page id is never the
largest; pages that repeat both id and payload are responses all if they have the
largest id; an empty table writes no file; other columns are not read.
"""

from __future__ import annotations

import base64
import dataclasses
import datetime
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

LEAST_SHARED = 1000
UNKNOWN_URL = "http://unknown.invalid/"
#: Header fields of each version, in their order (fixed values).
FIELDS = {
    "1": ("url", "ip", "date", "mime", "length"),
    "2": ("url", "ip", "date", "mime", "result", "checksum", "location", "offset", "filename", "length"),
}
TITLES = {
    "1": b"URL IP-address Archive-date Content-type Archive-length",
    "2": b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
NAMESPACE = uuid.UUID("5f1c3a52-7d0c-5b1e-9a53-1f6f8d0c2b11")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class ArchiveError(ValueError):
    """A file that does not keep to its format."""


@dataclasses.dataclass(frozen=True)
class ArcRecord:
    version: str
    fields: dict[str, str]
    block: bytes

    @property
    def url(self) -> str:
        return self.fields["url"]

    @property
    def iso_date(self) -> str:
        told = self.fields["date"]
        if not re.fullmatch(r"\d{8}(\d{2}){0,3}", told):
            raise ArchiveError(f"no ARC date: {told!r}")
        full = told.ljust(14, "0")
        return datetime.datetime.strptime(full, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file, its description first."""
    at, version = 0, None
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ArchiveError("a header line without an end")
        line = data[at:end].rstrip(b"\r").decode("utf-8", "replace")
        if not line:
            at = end + 1
            continue
        if version is None:
            # The description's own header has the fields of its version; its block says which.
            told = re.match(rb"(\d+) \S+ [^\n]*\n", data[end + 1 :])
            if not line.startswith("filedesc://") or not told or told[1].decode() not in FIELDS:
                raise ArchiveError("no ARC description at the start")
            version = told[1].decode()
        names = FIELDS[version]
        parts = line.rsplit(" ", len(names) - 1)
        if len(parts) != len(names) or not parts[-1].isdigit():
            raise ArchiveError(f"a header line of other fields than version {version} has: {line[:80]!r}")
        fields = dict(zip(names, parts, strict=True))
        start, size = end + 1, int(fields["length"])
        block = data[start : start + size]
        if len(block) != size:
            raise ArchiveError(f"{size} bytes declared, {len(block)} there")
        yield ArcRecord(version, fields, block)
        at = start + size
        if data[at : at + 1] == b"\n":
            at += 1
        elif at < len(data):
            raise ArchiveError("no line feed after a record")


def arc_description(version: str, name: str, date: str) -> bytes:
    body = f"{version} 0 tidemark\n".encode() + TITLES[version] + b"\n"
    head = f"filedesc://{name} 0.0.0.0 {date} text/plain" + (f" 200 - - 0 {name}" if version == "2" else "")
    return f"{head} {len(body)}\n".encode() + body + b"\n"


def arc_record(version: str, url: str, ip: str, date: str, mime: str, block: bytes, name: str = "-") -> bytes:
    extra = f" 200 {base64.b32encode(hashlib.sha1(block).digest()).decode()} - 0 {name}" if version == "2" else ""
    return f"{url} {ip} {date} {mime}{extra} {len(block)}\n".encode() + block + b"\n"


def payload_of(block: bytes) -> bytes:
    """What follows an HTTP head; a block without one is its own payload."""
    if block.startswith(b"HTTP/"):
        end = block.find(b"\r\n\r\n")
        return block[end + 4 :] if end >= 0 else b""
    return block


def sha1_hex(data: bytes) -> str:
    return hashlib.sha1(data).hexdigest()


def default_identifier(record: ArcRecord, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, ' '.join((record.url, record.fields['date'], record.fields['ip'], payload_digest)))}>"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))]) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def to_warc(record: ArcRecord, identify: Callable[[ArcRecord, str], str] = default_identifier, refers: Callable[[ArcRecord, str], tuple[str, str] | None] = lambda record, digest: None) -> bytes:
    """The WARC record of an ARC record; `refers` gives identifier and URL of the record with the same payload, for a revisit."""
    if record.url.startswith("filedesc://"):
        block = f"software: tidemark\r\nformat: WARC File Format 1.1\r\ndescription: converted from {record.url.removeprefix('filedesc://')}\r\n".encode()
        return _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", default_identifier(record, sha1_hex(record.block))), ("WARC-Date", record.iso_date), ("WARC-Filename", record.url.removeprefix("filedesc://")), ("Content-Type", "application/warc-fields")], block)
    payload = payload_of(record.block)
    digest = sha1_hex(payload)
    http = record.block.startswith(b"HTTP/")
    kind = "response" if http or record.url.startswith("dns:") else "resource"
    mime = "application/http;msgtype=response" if http else record.fields["mime"]
    headers = [("WARC-Record-ID", identify(record, digest)), ("WARC-Date", record.iso_date), ("WARC-Target-URI", record.url), ("WARC-IP-Address", record.fields["ip"]), ("WARC-Payload-Digest", f"sha1:{digest}")]
    block = record.block
    if (other := refers(record, digest)) is not None:
        kind, block = "revisit", record.block[: len(record.block) - len(payload)]
        headers += [("WARC-Refers-To", other[0]), ("WARC-Refers-To-Target-URI", other[1]), ("WARC-Profile", REVISIT_PROFILE)]
    return _record([("WARC-Type", kind), *headers, ("WARC-Block-Digest", f"sha1:{sha1_hex(block)}"), ("Content-Type", mime)], block)


def deflated(record: bytes) -> bytes:
    """One gzip member for one record, as is usual, so that a reader can begin at any record."""
    made = zlib.compressobj(1, zlib.DEFLATED, 31)
    return made.compress(record) + made.flush()


def inflated(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    rest, member, out = b"", zlib.decompressobj(31), []
    while True:
        data = rest or stream.read(size)
        rest = b""
        if not data:
            if out:
                raise ArchiveError("the last record is cut short")
            return
        out.append(member.decompress(data))
        if member.eof:
            rest = member.unused_data
            yield b"".join(out)
            member, out = zlib.decompressobj(31), []


@dataclasses.dataclass(frozen=True)
class WarcRecord:
    headers: dict[str, str]
    block: bytes


def parse_warc(data: bytes) -> WarcRecord:
    """One record; its declared length must be there and its digests right."""
    end = data.find(b"\r\n\r\n")
    lines = data[:end].decode("utf-8").split("\r\n")
    if end < 0 or not lines[0].startswith("WARC/"):
        raise ArchiveError("no WARC record")
    headers = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
    size = int(headers["content-length"])
    block = data[end + 4 : end + 4 + size]
    if data[end + 4 + size :] != b"\r\n\r\n" or len(block) != size:
        raise ArchiveError("a record of another length than declared")
    if "warc-block-digest" in headers and headers["warc-block-digest"] != f"sha1:{sha1_hex(block)}":
        raise ArchiveError("a block that does not match its digest")
    return WarcRecord(headers, block)


def page_identifier(page_id: int | None, place: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page {page_id}' if page_id is not None else f'no page {place}')}>"


_DATE = "20240101000000"
_KEY = re.compile(rb"\r\nX-Page-Id: (-?\d+|none [\d-]+)\r\n")


def _clean(url: str | None) -> str:
    return re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", url or "") or UNKNOWN_URL


def _archived(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    name, count, row = f"pages-{part:06d}", 0, 0
    # Both versions are in use in old archives: odd partitions are of the second.
    version = "12"[part % 2]

    def arc(batch: pa.RecordBatch) -> bytes:
        nonlocal row
        made = [arc_description(version, f"{name}.arc", _DATE)]
        for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
            payload = (html or "").encode("utf-8")
            key = str(page_id) if page_id is not None else f"none {part}-{row}"
            row += 1
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {key}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
            made.append(arc_record(version, _clean(url), "0.0.0.0", _DATE, "text/html", head + payload, f"{name}.arc"))
        return b"".join(made)

    def identity(record: ArcRecord, digest: str) -> str:
        told = _KEY.search(record.block[:400])[1].decode()
        return page_identifier(None, told[5:]) if told.startswith("none") else page_identifier(int(told), "")

    def pieces() -> Iterator[bytes]:
        nonlocal count
        for batch in shared.bounded(batches, "html", 2 << 20):
            keeps = iter(zip(batch.column("keep").to_pylist(), batch.column("keep_url").to_pylist(), strict=True))
            ids = iter(batch.column("page_id").to_pylist())

            def refers(record: ArcRecord, digest: str, ids=ids, keeps=keeps) -> tuple[str, str] | None:
                own, (keep, url) = next(ids), next(keeps)
                return None if keep is None or keep == own else (page_identifier(keep, ""), _clean(url))

            for k, record in enumerate(parse_arc(arc(batch))):
                if k or not count:
                    yield deflated(to_warc(record, identity, refers))
            count += batch.num_rows

    stream = pieces()
    first = next(stream, None)
    if first is None:
        return
    uri = f"{folder}/{name}.warc.gz"

    def chained() -> Iterator[bytes]:
        yield first
        yield from stream

    shared.write_once(uri, chained())
    yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([count], pa.int64())], names=["uri", "n_pages"])


def archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes every page; one row for each file: uri, n_pages."""
    rows = pages.select(shared.named(id_col).cast("long").alias("page_id"), shared.named(url_col).cast("string").alias("url"), F.coalesce(shared.named(html_col), F.lit("")).alias("html"))
    keyed = rows.select("*", F.sha2(F.col("html").cast("binary"), 256).alias("sha"), F.octet_length("html").alias("size"))
    large = keyed.where(F.col("size") >= LEAST_SHARED)
    # Groups of equal payloads, counted with partial aggregation; staged, so that the join below can split a large group.
    groups = shared.staged(large.groupBy("sha", "size").agg(F.max("page_id").alias("keep"), F.max_by("url", "page_id").alias("keep_url"), F.count("*").alias("n")).where("n > 1").select(F.col("sha").alias("g_sha"), F.col("size").alias("g_size"), "keep", "keep_url"), "payload-groups")
    told = keyed.join(groups, (F.col("sha") == F.col("g_sha")) & (F.col("size") == F.col("g_size")), "left").select("page_id", "url", "html", "keep", "keep_url")
    return shared.staged(shared.through(told, lambda it: _archived(it, folder), "uri string, n_pages long"), "archives")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["record_id", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_id"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        for uri in batch.column("uri").to_pylist():
            files, path = shared.file_system(uri)
            rows: list[tuple] = []
            with files.open_input_stream(path, compression=None) as stream:
                for data in inflated(stream):
                    record = parse_warc(data)
                    h = record.headers
                    if h["warc-type"] == "warcinfo":
                        continue
                    digest = h["warc-payload-digest"].removeprefix("sha1:")
                    if h["warc-type"] == "response" and sha1_hex(payload_of(record.block)) != digest:
                        raise ArchiveError(f"a payload in {uri} does not match its digest")
                    key = _KEY.search(record.block[:400])[1].decode()
                    size = int(re.search(rb"\r\nContent-Length: (\d+)\r\n", record.block[:400])[1])
                    rows.append((h["warc-record-id"], None if key.startswith("none") else int(key), size, digest, h["warc-type"], h.get("warc-refers-to")))
                    if len(rows) == 10_000:
                        yield table(rows)
                        rows = []
            if rows:
                yield table(rows)


def read(files: DataFrame) -> DataFrame:
    """Every page of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = files.sparkSession
    # A row for each file, that is for each partition.
    uris = [(r["uri"],) for r in files.select("uri").collect()]
    listed = spark.createDataFrame(spark.sparkContext.parallelize(uris, max(1, len(uris))), "uri string")
    rows = shared.staged(shared.through(listed, _read, "record_id string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_id string"), "archive-records")
    # Identifiers that are referred to, once each, then back to the revisits.
    named = rows.where("refers_id IS NOT NULL").select(F.col("refers_id").alias("wanted")).distinct()
    found = shared.staged(rows.where("record_type = 'response'").join(named, F.col("record_id") == F.col("wanted"), "left_semi").select(F.col("record_id").alias("r_id"), F.col("page_id").alias("refers_to")).distinct(), "referred")
    plain = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    revisits = rows.where("record_type = 'revisit'").join(found, F.col("refers_id") == F.col("r_id"), "left").select(*plain, "refers_to")
    return rows.where("record_type <> 'revisit'").select(*plain, F.lit(None).cast("long").alias("refers_to")).union(revisits)
