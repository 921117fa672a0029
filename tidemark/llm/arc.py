"""Legacy ARC archives to WARC.

An ARC file starts with a ``filedesc://`` record whose second line says the version;
version 1 record lines have five fields (url, ip, date, type, length), version 2
lines ten (with result code, checksum, location, offset and file name).  The parser
takes each record's payload by its declared length.  The converter writes a warcinfo
record for the version block, and gives each record a WARC identifier (a name-based
UUID), an ISO timestamp, a type (response or revisit) and a SHA-256 digest.  Pages have
no crawl date, so archives are written with one that follows from the id.

Defined cases: null html is an empty payload; a null url is written as ``about:blank``
and white space inside a url as %20, %09 and so on; of payloads of at least
``MIN_REVISIT`` bytes that are equal, the smallest id is the response and the others
revisit it; smaller ones are always responses; rows with a null id are responses;
rows that repeat the smallest id and its payload are all responses; an empty table gives
no archive; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded, durable

MIN_REVISIT = 100
#: Pages are written in archives of about so many bytes.
ARCHIVE_BYTES = 4 << 20
DATE = b"20240101000000"
SECONDS = 366 * 86_400
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:arc-to-warc")

# Field names of the two versions' record lines.
FIELDS = {
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}


class ArchiveError(ValueError):
    """A header line or a declared length doesn't fit the bytes."""


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    mime: str
    status: int
    payload: bytes


def date_of(key: int | None) -> bytes:
    """14 digits: a second of the year 2024 for each id."""
    if key is None:
        return DATE
    return (datetime(2024, 1, 1) + timedelta(seconds=key % SECONDS)).strftime("%Y%m%d%H%M%S").encode()


def _field(value: str) -> bytes:
    """A header field: white space and controls are percent-encoded."""
    return re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], value.encode("utf-8", "surrogatepass")) or b"-"


def arc_header(version: int, name: str = "pages.arc") -> bytes:
    """The version block that an archive starts with."""
    body = b"%d 0 tidemark\n%s\n\n" % (version, FIELDS[version])
    line = [b"filedesc://" + name.encode(), b"0.0.0.0", DATE, b"text/plain"]
    if version == 2:
        line += [b"200", b"-", b"-", b"0", name.encode()]
    return b" ".join([*line, b"%d" % len(body)]) + b"\n" + body + b"\n"


def arc_record(version: int, url: str, payload: bytes, offset: int = 0, name: str = "pages.arc", date: bytes = DATE) -> bytes:
    line = [_field(url or "about:blank"), b"0.0.0.0", date, b"text/html"]
    if version == 2:
        line += [b"200", b"-", b"-", b"%d" % offset, name.encode()]
    return b" ".join([*line, b"%d" % len(payload)]) + b"\n" + payload + b"\n"


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records after the version block, each by its declared length."""
    at, version = 0, 0
    while at < len(data):
        if data[at : at + 1] == b"\n":  # between records
            at += 1
            continue
        end = data.find(b"\n", at)
        fields = data[at:end].rstrip(b"\r").split(b" ")
        if end < 0 or not fields[-1].isdigit():
            raise ArchiveError(f"no header line at byte {at}")
        start, stop = end + 1, end + 1 + int(fields[-1])
        if stop > len(data):
            raise ArchiveError(f"a record at byte {at} declares {int(fields[-1])} bytes, {len(data) - start} are left")
        if not version:
            lines = [x.rstrip(b"\r") for x in data[start:stop].split(b"\n")]
            number = lines[0].split(b" ")[0]
            version = int(number) if number.isdigit() else 0
            if not fields[0].startswith(b"filedesc://") or version not in FIELDS or lines[1:2] != [FIELDS[version]]:
                raise ArchiveError("no version block that is known")
        else:
            if len(fields) != len(FIELDS[version].split()):
                raise ArchiveError(f"{len(fields)} fields at byte {at}")
            url, ip, date, mime = (x.decode("utf-8", "surrogatepass") for x in fields[:4])
            yield ArcRecord(url, ip, date, mime, int(fields[4]) if version == 2 else 200, data[start:stop])
        at = stop


def iso_date(date: str) -> str:
    """14 (or 12) digits as an ISO timestamp."""
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, key)}>"


def warc_record(record: ArcRecord, digest: str, key: str, refers_to: str | None = None) -> bytes:
    """A response record, or a revisit record of the record with key ``refers_to``, without its payload."""
    http = b"HTTP/1.0 %d OK\r\nContent-Type: %s\r\nContent-Length: %d\r\n\r\n" % (record.status, record.mime.encode(), len(record.payload))
    block = http if refers_to is not None else http + record.payload
    head = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), b"WARC-Record-ID: " + record_id(key).encode(), b"WARC-Target-URI: " + record.url.encode("utf-8", "surrogatepass"), b"WARC-Date: " + iso_date(record.date).encode(), b"WARC-IP-Address: " + record.ip.encode(), b"WARC-Payload-Digest: sha256:" + digest.encode(), b"X-Source-Key: " + key.encode()]
    if refers_to is not None:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: " + record_id(refers_to).encode(), b"X-Refers-To-Key: " + refers_to.encode()]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def warcinfo(version: int, name: str = "pages.arc") -> bytes:
    """The record that describes an archive, for its version block."""
    block = b"format: WARC File Format 1.1\r\ndescription: converted from ARC version %d\r\n" % version
    head = [b"WARC/1.1", b"WARC-Type: warcinfo", b"WARC-Record-ID: " + record_id(f"info-{version}-{name}").encode(), b"WARC-Date: " + iso_date(DATE.decode()).encode(), b"WARC-Filename: " + name.encode(), b"Content-Type: application/warc-fields", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record, by declared lengths."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ArchiveError(f"no WARC record at byte {at}")
        head = dict(x.decode("utf-8", "surrogatepass").split(": ", 1) for x in data[at:end].split(b"\r\n")[1:])
        start, stop = end + 4, end + 4 + int(head["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ArchiveError(f"the record at byte {at} doesn't end as declared")
        yield head, data[start:stop]
        at = stop + 4


def plan_revisits(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = MIN_REVISIT) -> DataFrame:
    """``(page_id, url, html, digest, refers_to)``; the page itself is never shuffled into one group.

    Digests are grouped with partial aggregation; only digests with more than one
    id come back to the rows, in a join whose hot keys can be split.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256))
    large = rows.where((F.octet_length("html") >= least) & F.col("page_id").isNotNull())
    firsts = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last")
    again = large.select("page_id", "digest").distinct().join(firsts, "digest").where("page_id != first").select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), F.col("first").alias("refers_to"))
    return rows.join(again, (F.col("page_id") == F.col("_id")) & (F.col("digest") == F.col("_digest")), "left").select("page_id", "url", "html", "digest", "refers_to")


def convert(planned: DataFrame) -> DataFrame:
    """``(warc)`` archives: each partition's rows go to ARC archives of both versions, and those to WARC."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, rows, total = 0, [], 0

        def archive() -> pa.RecordBatch:
            nonlocal turn, rows, total
            version = 1 + turn % 2
            parts, offset = [arc_header(version)], 0
            for key, url, payload, _ in rows:
                offset += len(parts[-1])
                parts.append(arc_record(version, url, payload, offset, date=date_of(key)))
            out = [warcinfo(version)] + [warc_record(r, hashlib.sha256(r.payload).hexdigest(), "" if k is None else str(k), None if f is None else str(f)) for r, (k, _, _, f) in zip(parse_arc(b"".join(parts)), rows, strict=True)]
            turn, rows, total = turn + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], names=["warc"])

        for batch in bounded(batches, "html"):
            for key, url, page, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                rows.append((key, url or "", page.encode("utf-8", "surrogatepass"), first))
                total += len(rows[-1][2])
                if total >= ARCHIVE_BYTES:
                    yield archive()
        if rows:
            yield archive()

    return planned.select("page_id", "url", "html", "refers_to").mapInArrow(run, "warc binary")


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, target_uri string, warc_date string"


def read_archives(archives: DataFrame) -> DataFrame:
    """A row for each WARC record; a response's digest is computed again from its payload and must agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("warc"):
                out: list[tuple] = []
                for head, block in parse_warc(data.as_py()):
                    if head["WARC-Type"] == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    if head["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
                        raise ArchiveError(f"the payload of {head['WARC-Record-ID']} isn't what its header says")
                    key, first = head.get("X-Source-Key", ""), head.get("X-Refers-To-Key")
                    out.append((int(key) if key else None, length, digest, head["WARC-Type"], None if first is None else int(first), head["WARC-Record-ID"], head["WARC-Target-URI"], head["WARC-Date"]))
                if out:
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[f.split()[0] for f in RECORD.split(", ")])

    return archives.mapInArrow(run, RECORD)


def round_trip(pages: DataFrame, **columns: str) -> DataFrame:
    """Write WARC archives of the pages to the shared folder and read them back."""
    return read_archives(durable(convert(plan_revisits(pages, **columns))))


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN f.first < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first < p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100
"""
