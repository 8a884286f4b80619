"""Web archives: legacy ARC archives to WARC records, written by Spark and read back.

An ARC archive starts with a version block whose last line names the fields of every record's
header line; version 1 and 2 differ in these.  The parser takes the fields from there and steps from
record to record by the declared length, never by searching.  The converter turns the version block
into ``warcinfo`` and each record into ``response``, or into ``revisit`` where an earlier record
holds the same payload, with record ids, dates, types and digests that the ARC lacked.

WARC files are written through Spark's text sink (a record is the value, its last CRLF the line
end) and read through the text source cut at the border of records, so both work on any file system
that Spark can reach, and a task holds records, never whole files.  A payload that contains such a
border is put together again by its declared length: gzip files are not split, so the parts follow
each other in one task.
"""
from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synthlab.session import scratch_path

#: fixed values: header fields of ARC versions 1 and 2
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: fixed values: WARC version line, revisit profile
WARC = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: payloads below this size are not deduplicated
LEAST_BYTES = 100
#: bytes of an ARC archive before the next is begun
ARC_BYTES = 4 << 20
CAPTURED = "20200101000000"
KEY = "X-Record-Key"
_BLANK = re.compile(r"\s")


@dataclass(frozen=True)
class Capture:
    """A record of either format."""
    uri: str
    date: str                    # 14 digits
    mime: str
    head: bytes                  # HTTP status line and headers, with the empty line
    payload: bytes
    key: str | None


# ---- ARC ------------------------------------------------------------------------------------

def arc_version_block(name: str, version: int, date: str = CAPTURED) -> bytes:
    body = f"{version} 0 synthlab\n{ARC_FIELDS[version]}\n".encode()
    length = str(len(body))
    values = [f"filedesc://{name}", "0.0.0.0", date, "text/plain"]
    if version == 2:
        values += ["200", "-", "-", "0", name]
    return " ".join([*values, length]).encode() + b"\n" + body


def arc_record(c: Capture, version: int, name: str, offset: int) -> bytes:
    """Blanks in the URL are percent-encoded: a header line is cut at spaces."""
    body = c.head + c.payload
    uri = _BLANK.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), c.uri) or "-"
    values = [uri, "0.0.0.0", c.date, c.mime]
    if version == 2:
        values += ["200", hashlib.sha1(body).hexdigest(), "-", str(offset), name]
    return b"\n" + " ".join([*values, str(len(body))]).encode() + b"\n" + body


def parse_arc(data: bytes) -> Iterator[Capture]:
    """Records of an archive; raises ValueError where lengths or header lines do not fit."""
    fields: list[str] | None = None
    at = 0
    while at < len(data):
        if data[at:at + 1] == b"\n":
            at += 1
            continue
        end = data.index(b"\n", at)
        line = data[at:end].decode("utf-8").split(" ")
        try:
            size = int(line[-1])
        except ValueError as e:
            raise ValueError(f"ARC header line without a length at byte {at}") from e
        body = data[end + 1:end + 1 + size]
        if len(body) != size:
            raise ValueError(f"ARC record at byte {at} declares {size} bytes, {len(body)} are there")
        at = end + 1 + size
        if fields is None:
            if not line[0].startswith("filedesc:"):
                raise ValueError("ARC archive without a version block")
            fields = body.decode("utf-8").split("\n")[1].split(" ")
            if fields not in [f.split(" ") for f in ARC_FIELDS.values()]:
                raise ValueError("unknown ARC version")
            continue
        if len(line) != len(fields):
            raise ValueError(f"ARC header line of {len(line)} fields, the version has {len(fields)}")
        value = dict(zip(fields, line))
        cut = body.find(b"\r\n\r\n") + 4
        head, payload = (body[:cut], body[cut:]) if body.startswith(b"HTTP/") and cut > 3 else (b"", body)
        key = re.search(rb"(?im)^" + KEY.encode() + rb": ([^\r\n]*)", head)
        yield Capture(value["URL"], value["Archive-date"], value["Content-type"], head, payload,
                      key[1].decode() if key else None)


def http_head(size: int, key: str | None, mime: str = "text/html") -> bytes:
    lines = ["HTTP/1.1 200 OK", f"Content-Type: {mime}; charset=utf-8", f"Content-Length: {size}"]
    return "\r\n".join([*lines, *([f"{KEY}: {key}"] if key is not None else []), "", ""]).encode()


def to_arc(pages: DataFrame, key: str = "page_id", uri: str = "url", html: str = "html",
           date: str = CAPTURED) -> DataFrame:
    """(name string, version int, arc binary): archives of about 4 MB, versions 1 and 2 in turn.

    A null key is left out of the HTTP head, a null URL is "-", a null page is an empty payload.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = 0
        for batch in batches:
            parts: list[bytes] = []
            size, name, version = 0, "", 1
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            for i, (k, u, t) in enumerate(rows):
                if not parts:
                    version = 1 + count % 2
                    name = f"pages-{rows[i][0]}.arc"
                    parts.append(arc_version_block(name, version, date))
                    size, count = len(parts[0]), count + 1
                payload = (t or "").encode()
                own = None if k is None else str(k)
                parts.append(arc_record(Capture(u or "-", date, "text/html", http_head(len(payload), own), payload, own),
                                        version, name, size))
                size += len(parts[-1])
                if size >= ARC_BYTES or i == len(rows) - 1:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name]), pa.array([version], pa.int32()), pa.array([b"".join(parts)])],
                        ["name", "version", "arc"])
                    parts = []
    chosen = pages.select(F.col(key).cast("string").alias("k"), F.col(uri).alias("u"), F.col(html).alias("t"))
    return chosen.mapInArrow(run, "name string, version int, arc binary")


CAPTURES = "uri string, date string, mime string, head binary, payload binary, key string, digest string, size bigint"


def parse_archives(archives: DataFrame, column: str = "arc") -> DataFrame:
    """Captures of all archives, with SHA-256 (bare lower-case hex) and size of the payload."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                found = list(parse_arc(data.as_py() or b""))
                if found:
                    cols = [pa.array([getattr(c, f) for c in found], t) for f, t in (
                        ("uri", pa.string()), ("date", pa.string()), ("mime", pa.string()), ("head", pa.binary()),
                        ("payload", pa.binary()), ("key", pa.string()))]
                    cols.append(pa.array([hashlib.sha256(c.payload).hexdigest() for c in found]))
                    cols.append(pa.array([len(c.payload) for c in found], pa.int64()))
                    yield pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in CAPTURES.split(", ")])
    return archives.select(column).mapInArrow(run, CAPTURES)


# ---- WARC -----------------------------------------------------------------------------------

def record_id(key: str) -> str:
    """A record id that follows from the key, so that references need no lookup."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, key)}>"


def warc_record(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    lines = [WARC.decode(), f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields.items()),
             f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def convert(c: Capture, digest: str, refers_to: str | None) -> bytes:
    """The WARC record of a capture; a revisit keeps the HTTP head, which tells the payload's size."""
    d = c.date.ljust(14, "0")
    own = c.key if c.key is not None else f"{c.uri} {c.date} {digest}"
    fields = {
        "WARC-Record-ID": record_id(own), "WARC-Target-URI": c.uri,
        "WARC-Date": f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
        "WARC-Payload-Digest": f"sha256:{digest}", "X-Payload-Length": str(len(c.payload)),
        "Content-Type": "application/http; msgtype=response" if c.head else c.mime,
    }
    if c.key is not None:
        fields[KEY] = c.key
    if refers_to is None:
        return warc_record("response", fields, c.head + c.payload)
    fields |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(refers_to),
               f"{KEY}-Referred": refers_to}
    return warc_record("revisit", fields, c.head)


def first_captures(captures: DataFrame, key_type: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(digest, first): the smallest key of each payload that occurs more than once."""
    return (captures.where(F.col("size") >= least_bytes).groupBy("digest")
            .agg(F.min(F.col("key").cast(key_type)).alias("first"), F.count(F.lit(1)).alias("n"))
            .where("n > 1 and first is not null").select("digest", F.col("first").cast("string").alias("first")))


def write_warc(captures: DataFrame, firsts: DataFrame, path: str | None = None) -> str:
    """Write one record for each capture to gzip WARC files and return their folder.

    ``firsts`` (digest, first) decides what is a revisit.  A payload that many captures share is a
    hot key of this join only; adaptive execution splits it, and nothing is grouped behind it.
    """
    spark = captures.sparkSession
    path = path or scratch_path(spark, "warc")
    joined = captures.join(firsts, "digest", "left").select(
        "uri", "date", "mime", "head", "payload", "key", "digest",
        F.when(~F.col("key").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = warc_record("warcinfo", {"WARC-Record-ID": record_id(path), "WARC-Date": "2020-01-01T00:00:00Z",
                                        "Content-Type": "application/warc-fields"},
                           b"software: synthlab\r\nformat: WARC File Format 1.1\r\n")
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(8)))
            out = [convert(Capture(u, d, m, h, p, k), g, r) for u, d, m, h, p, k, g, r in rows]
            if info:
                out, info = [info, *out], b""
            # the text sink ends every value with CRLF
            yield pa.RecordBatch.from_arrays([pa.array([r[:-2] for r in out], pa.binary())], ["value"])
    (joined.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
     .write.option("lineSep", "\r\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
     .text(path))
    return path


RECORDS = ("record_type string, record_id string, uri string, date string, key string, referred string, "
           "payload_bytes bigint, payload_digest string, payload binary")
_BORDER = b"\r\n\r\n" + WARC + b"\r\n"


def parse_warc(pieces: Iterator[bytes]) -> Iterator[tuple]:
    """Rows of ``RECORDS`` from the text between borders, in the order of the file.

    The digest and the size of a response's payload are computed from its bytes, and must agree with
    the header; those of a revisit are its header's.
    """
    held = b""
    for piece in pieces:
        record = held + _BORDER + piece if held else piece.removeprefix(WARC + b"\r\n")
        head, _, rest = record.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n"))
        size = int(fields["Content-Length"])
        if len(rest) < size:
            held = record
            continue
        held = b""
        kind = fields["WARC-Type"]
        if kind not in ("response", "revisit"):
            continue
        block = rest[:size]
        digest, length, payload = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Length"]), None
        if kind == "response":
            http = block.find(b"\r\n\r\n") + 4 if fields["Content-Type"].startswith("application/http") else 0
            payload = block[http:]
            if (hashlib.sha256(payload).hexdigest(), len(payload)) != (digest, length):
                raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
        yield (kind, fields["WARC-Record-ID"], fields["WARC-Target-URI"], fields["WARC-Date"], fields.get(KEY),
               fields.get(f"{KEY}-Referred"), length, digest, payload)
    if held:
        raise ValueError("WARC file ends inside a record")


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Response and revisit records of a folder of gzip WARC files (``RECORDS``); without
    ``payloads`` the payload column is null, after its digest was checked."""
    pieces = (spark.read.option("lineSep", _BORDER.decode()).text(path).select(F.col("value").cast("binary")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORDS.split(", ")]
        types = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        kinds = [types[f.split()[1]] for f in RECORDS.split(", ")]
        rows: list[tuple] = []
        held = 0
        for row in parse_warc(p.as_py() for batch in batches for p in batch.column(0)):
            rows.append(row if payloads else (*row[:-1], None))
            held += len(row[-1] or b"") if payloads else 0
            if len(rows) >= 2000 or held >= 16 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
    return pieces.mapInArrow(run, RECORDS)


def archive_pages(pages: DataFrame, key: str = "page_id", uri: str = "url", html: str = "html",
                  path: str | None = None, least_bytes: int = LEAST_BYTES) -> str:
    """Pages to ARC archives, ARC to WARC files; returns the WARC folder.

    One record per row.  Of rows with equal payloads of at least ``least_bytes`` bytes, those of the
    smallest key are responses and the others revisits of it; rows without a key count as revisits
    if another row with that payload has one.  Null pages are empty payloads, hence responses.  Rows
    repeated with one key are all responses.  Other columns are dropped; an empty table gives files
    without records.
    """
    kind = pages.schema[key].dataType.simpleString()
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    sizes = pages.select(F.col(key).alias("key"), F.sha2(payload, 256).alias("digest"),
                         F.octet_length(payload).alias("size"))
    return write_warc(parse_archives(to_arc(pages, key, uri, html)), first_captures(sizes, kind, least_bytes), path)


def page_records(pages: DataFrame, key: str = "page_id", uri: str = "url", html: str = "html") -> DataFrame:
    """Archive the pages and read the archives back: (key, payload_bytes long, payload_digest,
    record_type, refers_to), one row per page."""
    kind = pages.schema[key].dataType.simpleString()
    back = read_warc(pages.sparkSession, archive_pages(pages, key, uri, html), payloads=False)
    return back.select(F.col("key").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type",
                       F.col("referred").cast(kind).alias("refers_to"))
