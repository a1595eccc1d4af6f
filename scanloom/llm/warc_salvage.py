"""WARC archives written by Spark, and a reader that salvages what it can.

Writing: a row becomes one WARC/1.1 record in a gzip member of its own. Spark's text writer puts the
members into files (its commit protocol covers lost executors, its file systems are all there are);
between two members it writes an empty member, which readers of gzip pass over. Of records with
equal payloads the one with the smallest id is the response, the others are revisits that refer to
it and carry no payload.

Reading: a file is walked member by member (or record by record where it is not compressed). A record
counts if the member's checksum, the header, the length and the block digest hold. After a failed check
the reader searches for the next member or version line that does hold, goes on from there, and
logs the bytes between as a quarantined gap, with the reason. In a member of several records a failed
check costs the records it concerns; such a gap has the member's place and names the bytes within.

Null payloads count as empty. Ids may be null: such a record is a response unless a record with an
id has its payload, and refers to none among themselves. Rows that repeat an id and payload are all
responses if theirs is the smallest id. Null urls are left out of the header; line ends in urls are
escaped. An empty table gives archives without records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm.common import column_or_null, new_path, save, slices

VERSION = b"WARC/1.1"
#: Archives have no clock of their own: equal inputs give equal bytes.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MEMBER = b"\x1f\x8b\x08"
#: The empty gzip member that separates two records.
EMPTY = bytes.fromhex("1f8b0800000000000003" + "0300" + "00" * 8)
#: Bytes that the reader unpacks at once; what lies behind a member's end is handed back as a copy.
STEP = 4 << 10

RECORDS = ("file string, at long, span long, kind string, record_type string, page_id long, url string, payload_bytes long, "
           "payload_digest string, refers_to long, reason string")


def base32_sha1(data: Column) -> Column:
    """Upper-case base 32 of the SHA-1: five hexadecimal digits are four base-32 digits."""
    digits = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    plain = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
    return F.translate(F.upper(F.concat(*parts)), plain, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def digest_of(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# --- writing --------------------------------------------------------------------------------

def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """One record, uncompressed, with the two line ends that close it."""
    head = [("WARC-Type", "response" if refers_to is None else "revisit"),
            ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http
    if refers_to is None:
        block += payload
    else:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head += [("WARC-Block-Digest", f"sha1:{digest_of(block)}"), ("Content-Type", "application/http; msgtype=response"),
             ("Content-Length", str(len(block)))]
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in head)
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def with_revisits(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): equal payloads of at least `least` bytes refer to the smallest id.

    Only digests that occur more than once take part in the join, whose both sides can be split.
    """
    own = pages.select(F.col(key).cast("long").alias("page_id"), column_or_null(pages, url, "string").alias("url"),
                       F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary").alias("payload"))
    own = own.withColumn("digest", base32_sha1(F.col("payload"))).withColumn("bytes", F.length("payload"))
    firsts = save(own.filter(F.col("bytes") >= least).groupBy("digest", "bytes")
                  .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
                  .select("digest", "bytes", "first"), "firsts")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first"))
    return own.join(firsts, ["digest", "bytes"], "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_warc(rows: DataFrame, path: str, compress: bool = True) -> None:
    """Write (page_id, url, payload, digest, refers_to), a file per partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            found = [record(i, u, p, r, d) for i, u, p, d, r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([member(x) if compress else x for x in found], pa.binary())], ["value"])

    # A string column carries any bytes to the text writer; its separator is an empty member, or the
    # last line end of a record, which is cut off before.
    packed = rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "value binary")
    value = F.col("value") if compress else F.expr("substring(value, 1, length(value) - 2)")
    (packed.select(value.cast("string").alias("value")).write.option("encoding", "ISO-8859-1")
     .option("lineSep", (EMPTY if compress else b"\r\n").decode("latin-1")).text(path))


# --- reading --------------------------------------------------------------------------------

@dataclass
class Found:
    """A record (reason is None) or a gap of bytes that hold none."""

    at: int
    end: int
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""
    reason: str | None = None


class Damaged(Exception):
    pass


_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")


def _inflate(data: bytes, at: int) -> tuple[bytes, int]:
    """A whole member's content and where it ends; the checksum and length at its end are verified by zlib."""
    if data.startswith(EMPTY, at):
        return b"", at + len(EMPTY)
    unpacker, view, out = zlib.decompressobj(31), memoryview(data), []
    try:
        while not unpacker.eof and at < len(data):
            out.append(unpacker.decompress(view[at:at + STEP]))
            at = min(at + STEP, len(data))
    except zlib.error as e:
        raise Damaged(f"member: {e}") from None
    if not unpacker.eof:
        raise Damaged("member: cut off")
    return b"".join(out), at - len(unpacker.unused_data)


def _names(lines: bytes) -> set[bytes]:
    return {line.partition(b":")[0].lower() for line in lines.split(b"\r\n") if b":" in line}


def _parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at a version line."""
    if not _VERSION_LINE.match(data, at):
        raise Damaged("record: no version line")
    close = data.find(b"\r\n\r\n", at)
    if close < 0:
        raise Damaged("record: header does not end")
    for m in _VERSION_LINE.finditer(data, at + 8, close):
        # A value may end like a version line. It is the next record's where it begins a line or names come twice.
        before, after = _names(data[at:m.start()]), _names(data[m.end():close])
        if data.endswith(b"\r\n", at, m.start()) or before & after - {b"warc-concurrent-to"}:
            raise Damaged("record: cut off by the next one")
    headers: dict[str, str] = {}
    for line in data[at:close].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("record: header line without a colon")
        headers[name.decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"[0-9]{1,18}", headers.get("content-length", "")):
        raise Damaged("record: no length")
    if not {"warc-type", "warc-record-id", "warc-date"} <= headers.keys():
        raise Damaged("record: a required header is missing")
    end = close + 4 + int(headers["content-length"])
    block = data[close + 4:end]
    if end > len(data) or data[end:end + 4] != b"\r\n\r\n":
        raise Damaged("record: length does not fit")
    wanted = headers.get("warc-block-digest", "")
    if wanted.startswith("sha1:") and digest_of(block) != wanted[5:]:
        raise Damaged("record: block digest differs")
    return headers, block, end + 4


def _one(data: bytes, at: int) -> list[Found]:
    """The records and gaps of the member, or the plain record, at a place; empty members hold none."""
    if data.startswith(MEMBER, at):
        inner, end = _inflate(data, at)
        if not inner:
            return [Found(at, end)]
        out, place, gap, reason = [], 0, None, ""
        while place < len(inner):
            try:
                headers, block, after = _parse(inner, place)
            except Damaged as e:
                if gap is None:
                    gap, reason = place, str(e)
                start = _VERSION_LINE.search(inner, place + 1)
                place = start.start() if start else len(inner)
                continue
            if gap is not None:
                out.append(Found(at, end, reason=f"{reason} (bytes {gap} to {place} of the member)"))
                gap = None
            out.append(Found(at, end, headers, block))
            place = after
        if gap is not None:
            out.append(Found(at, end, reason=f"{reason} (bytes {gap} to {place} of the member)"))
        return out
    headers, block, end = _parse(data, at)
    return [Found(at, end, headers, block)]


_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")


def salvage(data: bytes) -> Iterator[Found]:
    """All records of a file in order, and a gap for each stretch of bytes that belongs to none."""
    at, gap, reason = 0, None, ""
    while at < len(data):
        try:
            found = _one(data, at)
        except Damaged as e:
            if gap is None:
                gap, reason = at, str(e)
            start = _START.search(data, at + 1)
            at = start.start() if start else len(data)
            continue
        if all(f.reason for f in found):  # a sound member without a sound record joins the gap around it
            if gap is None:
                gap, reason = at, found[0].reason
            at = found[-1].end
            continue
        if gap is not None:
            yield Found(gap, at, reason=reason)
            gap = None
        yield from (f for f in found if f.headers or f.reason)
        at = found[-1].end
    if gap is not None:
        yield Found(gap, len(data), reason=reason)


def _number(value: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?[0-9]+)>", value or "")
    return int(m[1]) if m else None


def _row(name: str, f: Found) -> dict:
    row = {"file": name, "at": f.at, "span": f.end - f.at, "kind": "gap" if f.reason else "record", "reason": f.reason}
    if f.reason:
        return row
    h, (head, _, payload) = f.headers, f.block.partition(b"\r\n\r\n")
    kind = h.get("warc-type")
    row |= {"record_type": kind, "page_id": _number(h.get("warc-record-id")), "url": h.get("warc-target-uri"),
            "refers_to": _number(h.get("warc-refers-to"))}
    if kind == "revisit":
        row |= {"payload_bytes": int(h.get("x-payload-length", 0)), "payload_digest": h.get("warc-payload-digest", "")[5:]}
    else:
        row |= {"payload_bytes": len(payload), "payload_digest": digest_of(payload)}
        if h.get("warc-payload-digest", "sha1:" + row["payload_digest"])[5:] != row["payload_digest"]:
            row |= {"kind": "gap", "reason": "record: payload digest differs"}
    return row


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row per record and per gap of all files in a folder, with file, offset and length.

    A file is read whole by one task, so archives should be of moderate size, as `write_warc` makes them.
    """
    schema = pa.schema([("file", pa.string()), ("at", pa.int64()), ("span", pa.int64()), ("kind", pa.string()),
                        ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()),
                        ("reason", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name, rows = batch.column(0)[k].as_py(), []
                for f in salvage(batch.column(1)[k].as_py()):
                    rows.append(_row(name, f))
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(run, RECORDS)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(with_revisits(spark.read.parquet(f"{sf_dir}/pages.parquet")), path)
    return read_warc(spark, path).filter("kind = 'record'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
