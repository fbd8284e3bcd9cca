"""Operator 5, WARC: legacy archive converter.

ARC files hold version blocks (``filedesc://``) and records of one header line, whose fields depend on the
version, and a body of the declared length. The converter reads header lines and lengths of versions 1 and 2, of
any origin, and synthesises WARC/1.1 records: identifiers derived from the record's content and place of origin (the
page_id, else archive name and offset; so a repeated task makes the same ones), ISO timestamps from ARC dates,
payload and block digests, and types: a version block becomes a warcinfo, an http answer (a body that begins
with an HTTP status line) or a dns: answer a response, any other body a resource of its media type, and a repeated
payload a revisit. Of equal payloads of ``least`` bytes or more, the record with the largest page_id is the
response and the others are revisits of it; smaller ones are all responses.

The page_id of a record is the X-Page-Id of its HTTP header, which archives written here have; records of other
archives have none, are never revisits and never referred to.

Archives are written and read by Spark's own file sources (gzip, in the shared folder), one to an input
split, so their size is bounded by spark.sql.files.maxPartitionBytes and any store works. They are unzipped and
parsed piece by piece: a task holds the packed archive and one record.

A null html is an empty payload, a null url becomes ``urn:page:`` and the page_id. A row without page_id is a record
like any other; it comes back with a null page_id, as a response. Rows that repeat a page_id are records of their
own; if the payload repeats too, both are of the same type. Extra columns stay behind. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, forget, forget_folders, new_folder, only, tune

DATE = "20240101000000"
#: The field names of both ARC versions' header lines.
FIELDS = {
    b"1": "URL IP-address Archive-date Content-type Archive-length",
    b"2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
RECORD = "page_id long, kind string, origin string, uri string, arc_date string, media string, http binary, payload binary"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
BREAK = b"\r\n\r\n"
STATUS = re.compile(rb"HTTP/\d")
PAGE = re.compile(rb"(?im)^X-Page-Id: *(-?\d+)")


def version_block(version: bytes) -> bytes:
    body = b"%s 0 cinderframe\n%s\n" % (version, FIELDS[version].encode())
    name = b"filedesc://pages.arc 0.0.0.0 %s text/plain " % DATE.encode()
    return name + (b"200 - - 0 pages.arc " if version == b"2" else b"") + b"%d\n" % len(body) + body


def arc_record(page_id: int | None, url: str | None, html: str | None, version: bytes) -> bytes:
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or f"urn:page:{'' if page_id is None else page_id}").encode()
    payload = (html or "").encode()
    own = b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + own + b"Content-Length: %d" % len(payload) + BREAK + payload
    more = b"200 - - 0 pages.arc " if version == b"2" else b""
    return b"%s 0.0.0.0 %s text/html %s%d\n" % (uri, DATE.encode(), more, len(body)) + body


class Pieces:
    """Bytes of a gzip archive, or of plain ones, that are read in order; what was read is let go."""

    def __init__(self, content: bytes, step: int = 1 << 20):
        self.chunks, self.held, self.pos, self.before = self._unzipped(content, step), b"", 0, 0

    @property
    def at(self) -> int:
        """How many bytes were read."""
        return self.before + self.pos

    @staticmethod
    def _unzipped(content: bytes, step: int) -> Iterator[bytes]:
        if content[:2] != b"\x1f\x8b":
            yield content
            return
        rest = memoryview(content)
        while len(rest):  # members follow one another
            d = zlib.decompressobj(31)
            while not d.eof and (len(rest) or d.unconsumed_tail):
                part, rest = (d.unconsumed_tail, rest) if d.unconsumed_tail else (rest[:step], rest[step:])
                yield d.decompress(part, step)
            rest = memoryview(d.unused_data + bytes(rest)) if d.unused_data else rest

    def more(self, n: int = 1) -> bool:
        """Hold at least n further bytes, if there are any."""
        parts, size = [self.held[self.pos :]], 0
        while size < n and (piece := next(self.chunks, None)) is not None:
            parts.append(piece)
            size += len(piece)
        self.before += self.pos
        self.held, self.pos = b"".join(parts), 0
        return size > 0

    def take(self, n: int) -> bytes:
        """The next n bytes, fewer at the end."""
        lack = n - (len(self.held) - self.pos)
        if lack > 0:
            self.more(lack)
        out = self.held[self.pos : self.pos + n]
        self.pos += len(out)
        return out

    def until(self, mark: bytes) -> bytes | None:
        """The bytes up to a mark, which is passed over; all that is left if there is none, null at the end."""
        start = self.pos
        while (end := self.held.find(mark, start)) < 0:
            seen = max(0, len(self.held) - self.pos - len(mark) + 1)
            if not self.more(len(self.held) - self.pos or 1):
                return self.take(len(self.held)) or None
            start = self.pos + seen
        out = self.held[self.pos : end]
        self.pos = end + len(mark)
        return out

    def skip(self, letters: bytes) -> None:
        while True:
            while self.pos < len(self.held) and self.held[self.pos] in letters:
                self.pos += 1
            if self.pos < len(self.held) or not self.more():
                return


def read_arc(data: bytes, name: str = "") -> Iterator[tuple[int | None, str, str, str, str, str, bytes, bytes]]:
    """(page_id, kind, origin, uri, date, media type, http header, payload) of every record, ``name`` being the archive's.

    kind: warcinfo for version blocks, response for http and dns: answers, else resource.
    """
    file, names = Pieces(data), []
    while True:
        file.skip(b"\r\n")
        at = file.at
        line = file.until(b"\n")
        if line is None:
            return
        values = line.decode("utf-8", "replace").rstrip("\r").split(" ")
        if not values[-1].isdigit():
            raise ValueError(f"header line without a length at byte {at}")
        size = int(values[-1])
        body = file.take(size)
        if len(body) < size:
            raise ValueError(f"record at byte {at} declares {size} bytes, {len(body)} are left")
        origin = f"{name}:{at}"
        if values[0].startswith("filedesc://"):
            number = body.split(b" ", 1)[0]
            if number not in FIELDS:
                raise ValueError(f"unknown ARC version {number!r}")
            lines = body.split(b"\n", 2)
            names = (lines[1].decode().strip() if len(lines) > 1 else "").split(" ")
            if names[0] != "URL":
                names = FIELDS[number].split(" ")
            yield None, "warcinfo", origin, values[0], values[2], values[3], b"", body
            continue
        if len(values) != len(names):
            raise ValueError(f"header line of {len(values)} fields at byte {at}, the version has {len(names)}")
        field = dict(zip(names, values))
        uri, date, media = field["URL"], field["Archive-date"], field["Content-type"]
        if STATUS.match(body):
            http, mark, payload = body.partition(BREAK)
            if not mark:  # old servers part the header by line feeds alone
                http, _, payload = body.partition(b"\n\n")
            page = PAGE.search(http)
            yield int(page[1]) if page else None, "response", origin, uri, date, media, http, payload
        else:
            yield None, "response" if uri.startswith("dns:") else "resource", origin, uri, date, media, b"", body


def warc_record(page_id: int | None, kind: str, origin: str, uri: str, date: str, media: str, http: bytes, payload: bytes, refers_to: int | None = None) -> bytes:
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    date = date.ljust(14, "0")
    when = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
    if refers_to is not None:
        kind = "revisit"
    if kind == "warcinfo":
        lines = payload.decode("utf-8", "replace").split("\n")
        payload = f"software: {' '.join(lines[0].split(' ')[2:]) or 'unknown'}\r\nformat: WARC File Format 1.1\r\nconverted-from: {uri}\r\n".encode()
    block = (http + BREAK if http else b"") + (b"" if kind == "revisit" else payload)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_uuid(page_id, origin, digest)}>", f"WARC-Date: {when}"]
    head.append(f"WARC-Filename: {uri.removeprefix('filedesc://')}" if kind == "warcinfo" else f"WARC-Target-URI: {uri}")
    if kind != "warcinfo":
        head.append(f"WARC-Payload-Digest: {digest}")
    head.append("WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode())
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{record_uuid(refers_to, '', digest)}>", f"X-Refers-To-Page-Id: {refers_to}"]
    content = "application/warc-fields" if kind == "warcinfo" else "application/http; msgtype=response" if http else "text/dns" if uri.startswith("dns:") else media
    head += [f"Content-Type: {content}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + BREAK + block


def record_uuid(page_id: int | None, origin: str, digest: str) -> uuid.UUID:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"urn:page:{page_id}:{digest}" if page_id is not None else f"urn:arc:{origin}:{digest}")


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of every record, by declared lengths."""
    file = Pieces(data)
    while True:
        at, head = file.at, file.until(BREAK)
        if head is None:
            return
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/1."):
            raise ValueError(f"no WARC record at byte {at}")
        field = dict(line.split(": ", 1) for line in lines[1:])
        block = file.take(int(field["Content-Length"]))
        if len(block) < int(field["Content-Length"]) or file.take(len(BREAK)) != BREAK:
            raise ValueError(f"record at byte {at} does not end where it declares")
        yield field, block


def warc_row(field: dict[str, str], block: bytes) -> tuple[int | None, int, str, str, int | None] | None:
    """The result's row, none for a warcinfo; a revisit's payload length is that of its stored http header."""
    kind = field["WARC-Type"]
    if kind == "warcinfo":
        return None
    digest = base64.b32decode(field["WARC-Payload-Digest"].removeprefix("sha1:"))
    page = int(field["X-Page-Id"]) if "X-Page-Id" in field else None
    http, mark, payload = block.partition(BREAK) if field["Content-Type"].startswith("application/http") else (b"", b"", block)
    if kind != "revisit":
        if hashlib.sha1(payload).digest() != digest:
            raise ValueError(f"payload of {field['WARC-Record-ID']} does not have its digest")
        return page, len(payload), digest.hex(), kind, None
    size = int(re.search(rb"(?im)^Content-Length: *(\d+)", http)[1])
    return page, size, digest.hex(), kind, int(field["X-Refers-To-Page-Id"])


def as_text(rows: list[bytes]) -> pa.Array:
    """Bytes in a string column as they are: Spark's text writer passes them on, valid UTF-8 or not."""
    raw = pa.array(rows, pa.binary())
    return pa.Array.from_buffers(pa.string(), len(raw), raw.buffers())


def write_archives(records: DataFrame, name: str, end: str) -> str:
    """Write a string column ``value`` as gzip archives whose records end with ``end``; returns the folder."""
    path = new_folder(records.sparkSession, name)
    records.write.mode("overwrite").option("lineSep", end).option("compression", "gzip").text(path)
    return path


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(name, content) of the archives in a folder, part files only, packed or not."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,arc,warc}").load(path)
    return files.select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "content")


def write_arc(pages: DataFrame) -> str:
    """Write pages (page_id, url, html) as ARC files, each batch under a version block of its own, versions in turn."""

    def run(batches):
        for k, batch in enumerate(batches):
            version = b"12"[k % 2 : k % 2 + 1]
            rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")))
            yield pa.RecordBatch.from_arrays([as_text([version_block(version).rstrip(b"\n"), *(arc_record(*r, version) for r in rows)])], ["value"])

    return write_archives(only(pages, page_id="long", url="string", html="string").mapInArrow(run, "value string"), "arc", "\n")


def arc_rows(spark: SparkSession, path: str) -> DataFrame:
    """The records of ARC files."""
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.binary())

    def run(batches):
        for batch in batches:
            for name, content in zip(*batch.columns):
                rows = read_arc(content.as_py(), name.as_py())
                while part := list(islice(rows, 500)):
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*part), kinds)], ["page_id", "kind", "origin", "uri", "arc_date", "media", "http", "payload"])

    return archives(spark, path).mapInArrow(run, RECORD)


def convert(spark: SparkSession, arc_path: str, least: int = 1000) -> str:
    """Write the records of ARC files as WARC files; returns their folder."""
    records = arc_rows(spark, arc_path)
    large = records.where((F.length("payload") >= least) & F.col("page_id").isNotNull()).select("page_id", F.sha1("payload").alias("digest"))
    large = cut(large, "digests")
    kept = cut(large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("low")).where("low < refers_to").select("digest", "refers_to"), "responses")
    revisits = cut(large.join(kept, "digest").where("page_id < refers_to").select("page_id", "refers_to", "digest"), "revisits")
    joined = records.withColumn("digest", F.when(F.length("payload") >= least, F.sha1("payload"))).join(revisits.dropDuplicates(["page_id", "digest"]), ["page_id", "digest"], "left")
    names = ("page_id", "kind", "origin", "uri", "arc_date", "media", "http", "payload", "refers_to")

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in names))
            yield pa.RecordBatch.from_arrays([as_text([warc_record(*r) for r in rows])], ["value"])

    path = write_archives(joined.select(*names).mapInArrow(run, "value string"), "warc", "\r\n\r\n")
    forget(large, kept, revisits)
    return path


def warc_rows(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of WARC files, digests checked."""
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())

    def run(batches):
        for batch in batches:
            for content in batch.column(1):
                rows = (r for r in (warc_row(*x) for x in read_warc(content.as_py())) if r is not None)
                while part := list(islice(rows, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*part), kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return archives(spark, path).mapInArrow(run, RESULT)


def through_archives(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Pages to ARC files, these to WARC files, and their rows read back."""
    spark = pages.sparkSession
    tune(spark)
    arc = write_arc(pages)
    warc = convert(spark, arc, least)
    forget_folders(spark, arc)
    return warc_rows(spark, warc)
