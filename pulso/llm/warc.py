"""Legacy archive converter: ARC 1 and ARC 2 files to WARC 1.1.

ARC files start with a ``filedesc://`` block that names the version; its number
decides how many fields a record's header line has. Bodies are taken by the
declared length, so they may hold anything, header look-alikes included. Each record
is given what WARC asks for: a record id (a UUID from url, date, place and payload,
the same in every run), an ISO time from the 12, 14 or 17 digit date, a type, block
and payload digests (SHA-1, base32). Records with equal payloads of at least
``min_revisit`` bytes become revisits of the one with the smallest page id.

Archives are written and read by Spark's own text source with the record separator
as line separator, gzip-compressed, so they work on any file system Spark knows. A
gzip file is one task; records stream through it, and memory holds one record and
one Arrow batch. A byte stream is put together again from the pieces with their
separators, then cut by declared lengths.

The page id travels in the HTTP head (``X-Page-Id``). Scale: two writes and two reads
of the payloads; the duplicate table is narrow, combined map-side and written, and
joined by size as Spark sees it (AQE splits a hot payload's rows).

Defined cases: a null payload is an empty one. A null url becomes ``urn:page:<id>``; blanks
in urls are written as %20. A null page id is kept as null and never a revisit.
Rows that share page id and payload: where that id is the smallest they are all
responses. An empty table gives no rows. A file that ends inside a record loses that
record only; header lines that can't be read are skipped up to the next line.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import small_batches, table, written

ARC_SEP = "\n"
WARC_SEP = "\r\n\r\n"
MIN_REVISIT = 0
ARCHIVE_DATE = "20240101000000"
#: Header fields after the url, by ARC version.
ARC_FIELDS = {
    1: ("ip", "date", "mime", "length"),
    2: ("ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"),
}
ARC_DEFINITION = {
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_RECORD = ("page_id long, record_id string, url string, ip string, date string, type string, "
           "content_type string, head binary, payload binary, payload_bytes long, payload_digest string")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def iso_date(digits: str) -> str:
    """ISO time of a 12, 14 or 17 digit ARC date; the epoch if it isn't one."""
    if not digits.isdigit() or len(digits) not in (12, 14, 17):
        return "1970-01-01T00:00:00Z"
    d = digits.ljust(14, "0")
    more = f".{d[14:]}" if len(d) > 14 else ""
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}{more}Z"


# ---------------------------------------------------------------- byte streams

class _Stream:
    """A growing byte buffer read from the front."""

    def __init__(self):
        self.parts: list[bytes] = []
        self.size = self.need = self.pos = 0
        self.buf = b""

    def feed(self, chunk: bytes) -> bool:
        """Add bytes; true if enough are there to go on."""
        self.parts.append(chunk)
        self.size += len(chunk)
        if self.size < self.need:
            return False
        self.buf = b"".join([self.buf[self.pos:], *self.parts])
        self.parts, self.pos, self.size = [], 0, 0
        return True

    def wait(self, start: int, length: int) -> None:
        """Keep what is left from ``start``; go on when it has ``length`` bytes."""
        self.pos = start
        self.need = max(1, length - (len(self.buf) - start))


def _chunks(batches, sep: bytes) -> Iterator[bytes]:
    for batch in batches:
        yield sep.join(batch.column(0).to_pylist()) + sep if batch.num_rows else b""


def arc_records(chunks: Iterator[bytes]) -> Iterator[tuple[int, dict, bytes]]:
    """``(version, header fields, body)`` of each record, version blocks included."""
    s, version = _Stream(), 1
    for chunk in chunks:
        if not s.feed(chunk):
            continue
        at, buf = 0, s.buf
        while True:
            while at < len(buf) and buf[at] in b"\r\n":
                at += 1
            end = buf.find(b"\n", at)
            if end < 0:
                s.wait(at, len(buf) - at + 1)
                break
            parts = buf[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
            # a version block's own line has the fields of version 1
            names = ARC_FIELDS[1 if parts[0].startswith("filedesc:") else version]
            if len(parts) != len(names) + 1 or not parts[-1].isdigit():
                at = end + 1
                continue
            size = int(parts[-1])
            if len(buf) < end + 1 + size:
                s.wait(at, end + 1 + size - at)
                break
            body = buf[end + 1:end + 1 + size]
            fields = dict(zip(names, parts[1:]), url=parts[0])
            if parts[0].startswith("filedesc:"):
                first = body.split(b" ", 1)[0].strip()
                version = int(first) if first in (b"1", b"2") else 1
            yield version, fields, body
            at = end + 1 + size


def warc_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(header fields by lower-case name, block)`` of each record."""
    s = _Stream()
    for chunk in chunks:
        if not s.feed(chunk):
            continue
        at, buf = 0, s.buf
        while True:
            start = buf.find(b"WARC/", at)
            end = buf.find(b"\r\n\r\n", start) if start >= 0 else -1
            if end < 0:
                keep = start if start >= 0 else max(at, len(buf) - 4)
                s.wait(keep, len(buf) - keep + 1)
                break
            fields = {}
            for line in buf[start:end].decode("utf-8", "replace").split("\r\n")[1:]:
                name, _, value = line.partition(":")
                fields[name.strip().lower()] = value.strip()
            size = fields.get("content-length", "")
            size = int(size) if size.isdigit() else 0
            if len(buf) < end + 4 + size:
                s.wait(start, end + 4 + size - start)
                break
            yield fields, buf[end + 4:end + 4 + size]
            at = end + 4 + size


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Head (with its blank line) and payload of an HTTP response block."""
    end = block.find(b"\r\n\r\n")
    return (block, b"") if end < 0 else (block[:end + 4], block[end + 4:])


def http_field(head: bytes, name: str) -> str | None:
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        key, _, value = line.partition(":")
        if key.strip().lower() == name:
            return value.strip()
    return None


# ---------------------------------------------------------------- reading and writing

def _write(lines: DataFrame, path: str, sep: str) -> None:
    (lines.select(F.col("value").cast("string")).write.option("lineSep", sep)
     .option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path))


def _read(spark: SparkSession, path: str, sep: str) -> DataFrame:
    small_batches(spark, 4096)
    return spark.read.option("lineSep", sep).text(path).select(F.col("value").cast("binary"))


def write_arc(pages: DataFrame, path: str, versions: tuple[int, ...] = (1, 2)) -> None:
    """Pages as ARC files, one per partition, in the given versions by turns."""
    small_batches(pages.sparkSession)

    def run(batches):
        part = TaskContext.get().partitionId()
        version = versions[part % len(versions)]
        body = b"%d 0 pulso\n%s\n" % (version, ARC_DEFINITION[version])
        name = f"pages-{part:05d}.arc"
        yield pa.RecordBatch.from_arrays([pa.array([
            b"filedesc://%s 0.0.0.0 %s text/plain %d\n%s" % (
                name.encode(), ARCHIVE_DATE.encode(), len(body), body)], pa.binary())], names=["value"])
        for batch in batches:
            out = []
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                html = html or b""
                url = f"urn:page:{page_id}" if url is None else url
                url = "".join("%%%02X" % ord(c) if c in " \r\n\t" else c for c in url) or "urn:page:"
                mark = b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id
                block = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
                         b"%sContent-Length: %d\r\n\r\n%s" % (mark, len(html), html))
                more = "" if version == 1 else f"200 {sha1_base32(html)} - 0 {name} "
                out.append(f"{url} 0.0.0.0 {ARCHIVE_DATE} text/html {more}{len(block)}\n".encode("utf-8", "replace") + block)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    cols = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"),
                        F.col("html").cast("string").cast("binary"))
    _write(cols.mapInArrow(run, "value binary"), path, ARC_SEP)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """Records of ARC files with the identifiers, times, types and digests of WARC."""
    def run(batches):
        rows: list[tuple] = []
        size = 0
        for _, h, body in arc_records(_chunks(batches, ARC_SEP.encode())):
            if h["url"].startswith("filedesc:"):
                continue
            http = body.startswith(b"HTTP/")
            head, payload = split_http(body) if http else (b"", body)
            mark = http_field(head, "x-page-id") if http else None
            digest = sha1_base32(payload)
            name = f"{h['url']} {h['date']} {mark} {digest}"
            rows.append((int(mark) if mark and mark.lstrip("-").isdigit() else None,
                         f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}", h["url"], h["ip"],
                         iso_date(h["date"]), "response" if http else "resource",
                         "application/http; msgtype=response" if http else h["mime"],
                         head, payload, len(payload), digest))
            size += len(body)
            if size > 1 << 22:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    return _read(spark, path, ARC_SEP).mapInArrow(run, _RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names = [c.split(" ") for c in _RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), names)],
                                      names=[n for n, _ in names])


def write_warc(records: DataFrame, path: str, min_revisit: int = MIN_REVISIT) -> None:
    """Records (as of ``read_arc``) as WARC files; repeated payloads as revisits."""
    key = ["payload_digest", "payload_bytes"]
    first = F.struct("page_id", "record_id", "url", "date").alias("first")
    again = (records.where(F.col("page_id").isNotNull() & (F.col("type") == "response")
                           & (F.col("payload_bytes") >= min_revisit))
             .select(*key, first).groupBy(*key)
             .agg(F.min("first").alias("first"), F.count("*").alias("n")).where("n > 1"))
    again = written(again.drop("n"), "warc-repeats")

    def run(batches):
        info = b"software: pulso\r\nformat: WARC File Format 1.1\r\n"
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([_record([
            ("WARC-Type", "warcinfo"), ("WARC-Date", iso_date(ARCHIVE_DATE)),
            ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'warcinfo {part}')}>"),
            ("Content-Type", "application/warc-fields")], info)], pa.binary())], names=["value"])
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                ref = r["first"]
                revisit = (ref is not None and r["page_id"] is not None and r["type"] == "response"
                           and r["page_id"] != ref["page_id"])
                block = r["head"] if revisit else r["head"] + r["payload"]
                fields = [("WARC-Type", "revisit" if revisit else r["type"]),
                          ("WARC-Record-ID", f"<{r['record_id']}>"), ("WARC-Date", r["date"]),
                          ("WARC-Target-URI", r["url"]), ("WARC-IP-Address", r["ip"]),
                          ("Content-Type", r["content_type"]),
                          ("WARC-Payload-Digest", f"sha1:{r['payload_digest']}"),
                          ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}")]
                if revisit:
                    fields += [("WARC-Profile", REVISIT_PROFILE),
                               ("WARC-Refers-To", f"<{ref['record_id']}>"),
                               ("WARC-Refers-To-Target-URI", ref["url"]),
                               ("WARC-Refers-To-Date", ref["date"]),
                               ("X-Refers-To-Page-Id", str(ref["page_id"]))]
                out.append(_record(fields, block))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    small_batches(records.sparkSession)
    _write(records.join(again, key, "left").mapInArrow(run, "value binary"), path, WARC_SEP)


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC record without the separator that the writer puts after it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode("utf-8", "replace") + b"\r\n" + block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Response, revisit and resource records: ``page_id, url, date, record_type, refers_to,
    payload_bytes, payload_digest, verified`` (block digest as declared, and the
    payload's too where there is one) and ``payload`` (null for revisits)."""
    schema = ("page_id long, url string, date string, record_type string, refers_to long, "
              "payload_bytes long, payload_digest string, verified boolean, payload binary")
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(),
             pa.bool_(), pa.binary()]
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def number(x):
        return int(x) if x and x.lstrip("-").isdigit() else None

    def run(batches):
        rows: list[tuple] = []
        size = 0
        for h, block in warc_records(_chunks(batches, WARC_SEP.encode())):
            kind = h.get("warc-type")
            if kind not in ("response", "revisit", "resource"):
                continue
            http = h.get("content-type", "").startswith("application/http")
            head, payload = split_http(block) if http else (b"", block)
            declared = h.get("warc-payload-digest", "").removeprefix("sha1:")
            ok = h.get("warc-block-digest") == f"sha1:{sha1_base32(block)}"
            if kind == "revisit":
                n, digest, payload = number(http_field(head, "content-length")), declared, None
            else:
                n, digest = len(payload), sha1_base32(payload)
                ok = ok and digest == declared
            rows.append((number(http_field(head, "x-page-id")) if http else None, h.get("warc-target-uri"),
                         h.get("warc-date"), kind, number(h.get("x-refers-to-page-id")), n, digest, ok, payload))
            size += len(block)
            if size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return _read(spark, path, WARC_SEP).mapInArrow(run, schema)


def round_trip(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Pages to ARC files, those converted to WARC files, and these read back."""
    spark = pages.sparkSession
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arc(pages, arc)
    write_warc(read_arc(spark, arc), warc, min_revisit)
    return read_warc(spark, warc)


def query(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS n, sha1(body) AS hex FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY hex, n) AS first FROM h)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(0, 4), lambda g: array_to_string(list_transform(range(0, 8), lambda i:
    substr('{_B32}', CAST(((CAST('0x' || substr(hex, CAST(g * 10 + 1 AS INT), 10) AS BIGINT) >> CAST(35 - 5 * i AS INT)) & 31) AS INT) + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM m
"""
