"""WARC archives: records written by Spark's text sink, and a reader that salvages damaged files.

Writing: a record is its header and block as one value, and the sink's line separator is the
``CRLF CRLF`` that ends a WARC record. So files come under Spark's commit protocol, on any file
system, and a lost executor leaves no half-written archive. Rows of one payload are found by a
hash join whose small side holds repeated payloads only.

Reading: records are taken one after another, plain or from gzip members, and checked: version
line, header, block length, end of record, and the digest of the block. After a failed check
the reader searches for the next gzip member that inflates to a version line, or the next
version line that a header follows, goes on there, and logs the bytes between as a quarantined
gap with the reason. Every byte of a file is in a record or in a gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from brackenlog.session import fresh_dir

#: Tables of repeated payloads up to this many rows (about 100 bytes each) are broadcast.
BROADCAST_ROWS = 200_000
RECORDS_PER_FILE = 20_000
#: Bytes that are inflated at a time.
PIECE = 1 << 16
MEMBER = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/[01]\.\d+\r\n")
_FIELD = re.compile(rb"([^\x00-\x20:\x7f]+):[ \t]*([^\r\n]*)\r\n")
_HEX, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of a payload's SHA-1: four times 40 bits, each as eight digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), _HEX, _BASE32)


def decide(pages: DataFrame, least: int = 0) -> DataFrame:
    """``pages`` with ``payload, payload_bytes, payload_digest, record_type, refers_to``.

    Of rows with equal payloads of ``least`` bytes or more, that with the smallest page_id is the
    response and the others revisit it. A null html is an empty payload, a null page_id counts
    as larger than any other, and rows that share the smallest page_id are all responses.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    # Equality goes by SHA-256; the SHA-1 that the format asks for is not safe for that.
    rows = rows.withColumn("_same", F.unhex(F.sha2("payload", 256)))
    groups = rows.where(F.length("payload") >= least).groupBy("_same").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1 AND _first IS NOT NULL")
    folder = fresh_dir(pages.sparkSession, "warc-payloads")
    groups.select("_same", "_first").write.parquet(folder)
    repeated = pages.sparkSession.read.parquet(folder)
    if repeated.count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    rows = rows.join(repeated, "_same", "left")
    revisit = F.coalesce(F.col("_first") != F.col("page_id"), F.col("_first").isNotNull())
    return rows.select(
        "page_id",
        "url",
        "payload",
        F.length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("_first")).alias("refers_to"),
    )


def record() -> Column:
    """One record of a decided row as bytes in a string column, without its ending."""
    revisit = F.col("record_type") == "revisit"
    eol = F.lit("\r\n")
    # Spaces and control characters would break the header line.
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")

    def name(column):
        return F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(column).cast("string"), F.lit("none")), F.lit(">"))

    header = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), F.col("record_type"), eol,
        F.lit("WARC-Record-ID: "), name("page_id"), eol,
        F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\n"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), uri, eol), F.lit("")),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest"), eol,
        F.lit("WARC-Payload-Length: "), F.col("payload_bytes").cast("string"), eol,
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name("refers_to"), eol)).otherwise(F.lit("")),
        F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string")), eol, eol,
    )
    return F.concat(header, F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string")))


def write(decided: DataFrame, folder: str) -> None:
    """One record per row into ``folder``, in files of bounded record counts."""
    decided.select(record().alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", RECORDS_PER_FILE).text(folder)


class Record(NamedTuple):
    start: int
    end: int
    fields: dict[str, str]
    block: bytes


class Gap(NamedTuple):
    start: int
    end: int
    reason: str


def _record(data: bytes, at: int) -> tuple[Record | None, int, str]:
    """The record at ``at`` and where it ends, or the reason why there is none."""
    version = VERSION.match(data, at)
    if not version:
        return None, at, "no version line"
    fields, here = {}, version.end()
    while field := _FIELD.match(data, here):
        fields[field[1].decode("ascii", "replace").lower()] = field[2].decode("utf-8", "replace").strip()
        here = field.end()
    if data[here : here + 2] != b"\r\n":
        return None, at, "broken header"
    here += 2
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return None, at, "no content length"
    end = here + int(length)
    if end + 4 > len(data):
        return None, at, "truncated block"
    if data[end : end + 4] != b"\r\n\r\n":
        return None, at, "no end of record"
    block = data[here:end]
    kind, _, digest = fields.get("warc-payload-digest", "").partition(":")
    if kind.lower() == "sha1" and fields.get("warc-type") == "response" and digest.upper() != sha1(block):
        return None, at, "wrong digest"
    return Record(at, end + 4, fields, block), end + 4, ""


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(data: bytes, at: int) -> tuple[bytes | None, int]:
    """The gzip member at ``at``, checked by its own checksum, and where it ends."""
    inflate, out = zlib.decompressobj(31), []
    # In pieces, so that what follows the member is neither copied nor read.
    for here in range(at, len(data), PIECE):
        piece = data[here : here + PIECE]
        try:
            out.append(inflate.decompress(piece))
        except zlib.error:
            break
        if inflate.eof:
            return b"".join(out), here + len(piece) - len(inflate.unused_data)
    return None, at


class _Starts:
    """Where the next member or version line begins; each place is searched for once."""

    def __init__(self, data: bytes):
        self.data, self.member, self.line = data, -1, -1

    def after(self, at: int) -> int:
        """The first place from ``at`` on with a member that inflates or a line with a header, or the end."""
        data = self.data
        while True:
            if self.member < at:
                found = data.find(MEMBER, at)
                self.member = len(data) if found < 0 else found
            if self.line < at:
                found = VERSION.search(data, at)
                self.line = found.start() if found else len(data)
            here = min(self.member, self.line)
            if here == len(data) or (_has_header(data, here) if here == self.line else _opens(data, here)):
                return here
            at = here + 1


def _has_header(data: bytes, at: int) -> bool:
    version = VERSION.match(data, at)
    return bool(_FIELD.match(data, version.end()))


def _opens(data: bytes, at: int) -> bool:
    """Whether a member that begins with a version line starts here."""
    try:
        return bool(VERSION.match(zlib.decompressobj(31).decompress(data[at : at + 4096], 64)))
    except zlib.error:
        return False


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """All records of an archive and the gaps between them, in order."""
    at, starts = 0, _Starts(data)
    while at < len(data):
        if data.startswith(MEMBER, at):
            inner, end = _member(data, at)
            if inner is None:
                reason = "broken member"
            else:
                parts = list(salvage(inner))
                yield from (p._replace(start=at, end=end) for p in parts if isinstance(p, Record))
                for p in parts:
                    if isinstance(p, Gap):
                        yield Gap(at, end, f"{p.reason} at {p.start} of the member's content")
                at = end
                continue
        else:
            found, end, reason = _record(data, at)
            if found:
                yield found
                at = end
                continue
        to = starts.after(at + 1)
        yield Gap(at, to, reason)
        at = to


_ROWS = pa.schema([("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("gap", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])
_SHAPE = "path string, start long, end long, gap string, fields map<string,string>, block binary"


def _salvaged(batches):
    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ROWS.types)], schema=_ROWS)

    for given in batches:
        for path, data in zip(given.column("path").to_pylist(), given.column("content").to_pylist()):
            rows, held = [], 0
            for x in salvage(data):
                rows.append((path, x.start, x.end, x.reason, None, None) if isinstance(x, Gap) else (path, x.start, x.end, None, list(x.fields.items()), x.block))
                held += len(rows[-1][5] or b"")
                if held > 8 << 20 or len(rows) >= 5000:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)


def read(spark, folder: str) -> DataFrame:
    """``path, start, end, gap, fields, block``: a row per record, and per gap with its reason.

    A file is one task's work and is held whole, so archives should be cut at some 100 MB, as
    ``write`` does. An empty file has no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.where(~F.col("path").rlike(r"/[._][^/]*$")).select("path", "content").mapInArrow(_salvaged, _SHAPE)


def pages(records: DataFrame) -> DataFrame:
    """``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to`` of records.

    A response's length and digest are taken from its payload. A revisit has them from its header.
    """
    f, response = F.col("fields"), F.col("fields")["warc-type"] == "response"

    def page(name):
        return F.regexp_extract(f[name], r"^<urn:x-page:(-?\d+)>$", 1)

    return records.where("gap IS NULL").select(
        F.when(page("warc-record-id") != "", page("warc-record-id").cast("long")).alias("page_id"),
        f["warc-target-uri"].alias("url"),
        F.when(response, F.col("block")).alias("payload"),
        F.when(response, F.length("block").cast("long")).otherwise(f["warc-payload-length"].cast("long")).alias("payload_bytes"),
        F.when(response, base32_sha1(F.col("block"))).otherwise(F.substring_index(f["warc-payload-digest"], ":", -1)).alias("payload_digest"),
        f["warc-type"].alias("record_type"),
        F.when(page("warc-refers-to") != "", page("warc-refers-to").cast("long")).alias("refers_to"),
    )
