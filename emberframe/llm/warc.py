"""WARC archives: a writer with payload revisits and a reader that salvages damaged files."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
HEADER_BYTES = 8 << 20  # a longer header is damage
DIGITS = 18  # of a length; a longer number is damage
EMPTY_MEMBER = gzip.compress(b"", mtime=0).decode("latin-1")
READ_SCHEMA = (
    "path string, kind string, start long, length long, reason string, record_type string, record_id string, "
    "refers_to string, target_uri string, payload_digest string, payload_bytes long, payload binary"
)


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _field(name: str, value: str | None) -> bytes:
    """One header line; control characters of the value are percent-encoded."""
    if value is None:
        return b""
    return name.encode() + b": " + re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value).encode() + b"\r\n"


def record(
    record_id: str, payload: bytes, *, url: str | None = None, refers_to: str | None = None, date: str = "1970-01-01T00:00:00Z",
) -> bytes:
    """A response record, or a revisit of ``refers_to`` that holds only the HTTP header."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = _field("WARC-Type", "response" if refers_to is None else "revisit")
    lines += _field("WARC-Record-ID", f"<{record_id}>") + _field("WARC-Date", date) + _field("WARC-Target-URI", url)
    if refers_to is not None:
        lines += _field("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines += _field("WARC-Refers-To", f"<{refers_to}>")
    lines += _field("WARC-Payload-Digest", f"sha1:{digest(payload)}") + _field("WARC-Block-Digest", f"sha1:{digest(block)}")
    lines += b"Content-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n" % len(block)
    return b"WARC/1.1\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def first_holders(pages: DataFrame, *, key: str, payload: str, min_bytes: int = 0) -> DataFrame:
    """``pages`` plus ``refers_to``: for all but the smallest key of equal payloads, that smallest key.

    Only digests are grouped and joined, never payloads: SHA-256 and length per row, the minimum
    per digest with map-side combine, then one join of the digests and one by key. An input column ``refers_to`` is replaced.
    """
    pages = pages.drop("refers_to") if "refers_to" not in (key, payload) else pages
    own = {c.lower() for c in pages.columns}
    again_key, first = (next(n for i in range(len(own) + 1) if (n := f"_{base}{i}") not in own) for base in ("key", "first"))
    content = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    marks = pages.select(F.col(key).alias(again_key), F.sha2(content, 256).alias("_mark"), F.octet_length(content).alias("_n")).where(
        (F.col("_n") >= min_bytes) & F.col(again_key).isNotNull()
    )
    again = marks.groupBy("_mark").agg(F.min(again_key).alias(first), F.count("*").alias("_c")).where("_c > 1").select("_mark", first)
    later = marks.join(again, "_mark").where(F.col(again_key) > F.col(first)).select(again_key, first).distinct()
    return pages.join(later, F.col(key) == F.col(again_key), "left").drop(again_key).withColumnRenamed(first, "refers_to")


def write(
    pages: DataFrame, path: str, *, key: str = "page_id", payload: str = "html", url: str = "url", min_bytes: int = 0,
    compress: bool = True, records_per_file: int = 4096,
) -> None:
    """Write one record per row below ``path``, equal payloads as revisits of the smallest key.

    Spark's text sink writes the bytes, so any file system of the cluster serves. Compressed records are
    gzip members of their own; the sink's separator is then an empty member, otherwise the two line ends
    that close a record. A null payload is empty, a null key is written as such and neither revisits nor
    is revisited. Keys must be whole numbers. Files hold at most ``records_per_file`` records.
    """

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part, out = batch.slice(start, 256), []
                for k, body, address, first in zip(*(part.column(c).to_pylist() for c in ("k", "body", "address", "first"))):
                    raw = record(
                        f"urn:record:{'none' if k is None else k}", body or b"", url=address,
                        refers_to=None if first is None else f"urn:record:{first}",
                    )
                    if compress:
                        out.append(gzip.compress(raw, 4, mtime=0))
                    else:
                        out.append(raw[:-4])
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    marked = first_holders(pages.select(key, payload, url), key=key, payload=payload, min_bytes=min_bytes)
    rows = marked.select(
        F.col(key).cast("long").alias("k"), F.col(payload).cast("binary").alias("body"), F.col(url).alias("address"),
        F.col("refers_to").cast("long").alias("first"),
    )
    writer = rows.mapInArrow(lines, "value binary").select(F.col("value").cast("string")).write.option("maxRecordsPerFile", records_per_file)
    if compress:
        writer.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER).text(path)
    else:
        writer.option("lineSep", "\r\n\r\n").text(path)


def _parse(data: bytes, at: int) -> tuple[dict | None, int, str]:
    """The record at ``at``: (fields or None, end, reason)."""
    if not (version := VERSION.match(data, at)):
        return None, at, "no version line"
    close = data.find(b"\r\n\r\n", at, at + HEADER_BYTES)
    if close < 0:
        return None, at, "header is cut off"
    fields = {}
    for line in data[version.end() : close].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None, at, "header line without a colon"
        fields.setdefault(name.strip().lower().decode("latin-1"), value.strip().decode("utf-8", "replace"))
    size = fields.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        return None, at, "no content length"
    if len(size.lstrip("0")) > DIGITS:
        return None, at, "content length is out of range"
    start, end = close + 4, close + 4 + int(size)
    if data[end : end + 4] != b"\r\n\r\n":
        return None, at, "block does not end where its length says"
    block = data[start:end]
    if (known := fields.get("warc-block-digest")) and known != f"sha1:{digest(block)}":
        return None, at, "block digest differs"
    _, blank, payload = block.partition(b"\r\n\r\n")
    fields["payload"] = payload if blank and "application/http" in fields.get("content-type", "") else block
    if fields.get("warc-type") == "revisit":
        length = re.search(rb"(?i)content-length: *0*(\d{1,%d})(?!\d)" % DIGITS, block)
        fields["payload_bytes"], fields["payload"] = (int(length[1]) if length else None), None
    else:
        fields["payload_bytes"] = len(fields["payload"])
        if (known := fields.get("warc-payload-digest")) and known != f"sha1:{digest(fields['payload'])}":
            return None, at, "payload digest differs"
    return fields, end + 4, ""


def _member(data: bytes, at: int) -> tuple[bytes | None, int, str]:
    """The gzip member at ``at``: (content or None, end, reason). Reads growing blocks, so the cost is that of the member."""
    unpack, parts, whole, block = zlib.decompressobj(31), [], memoryview(data), 1 << 12
    place = at
    while place < len(data) and not unpack.eof:
        try:
            parts.append(unpack.decompress(whole[place : place + block]))
        except zlib.error as e:
            return None, at, f"gzip: {e}"
        place, block = min(place + block, len(data)), min(block * 4, 1 << 18)
    if not unpack.eof:
        return None, at, "gzip member is cut off"
    return b"".join(parts), place - len(unpack.unused_data), ""


def _blank(data: bytes, at: int) -> int:
    while data[at : at + 2] == b"\r\n":
        at += 2
    return at


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | str]]:
    """(start, length, fields) of every record that passes its checks and (start, length, reason) of every gap.

    After a failed check the next valid member or version line is looked for byte by byte behind the failure, so a wrong
    length cannot hide later records. Offsets count in the file as stored; a gap inside a
    member carries the member's place.
    """
    at, bad, why = 0, None, ""
    seen = {MAGIC: -1, b"WARC/1.": -1}  # the next place of each mark, as far as it is known
    while at < len(data):
        if data.startswith(MAGIC, at):
            content, end, reason = _member(data, at)
            found = [] if content is None else list(_plain(content))
        else:
            at = at if bad is not None else _blank(data, at)
            if at >= len(data):
                break
            if data.startswith(MAGIC, at):
                continue
            fields, end, reason = _parse(data, at)
            content, found = (b"", [fields]) if fields is not None else (None, [])
        if content is None:
            bad, why = (at, reason) if bad is None else (bad, why)
            for mark, place in seen.items():
                if place <= at:
                    found_at = data.find(mark, at + 1)
                    seen[mark] = found_at if found_at >= 0 else len(data)
            at = min(seen.values())
            continue
        if bad is not None:
            yield bad, at - bad, why
            bad = None
        for item in found:
            yield at, end - at, item
        at = end
    if bad is not None:
        yield bad, len(data) - bad, why


def _plain(content: bytes) -> Iterator[dict | str]:
    """Records, and reasons of gaps, inside one member."""
    at, why = _blank(content, 0), ""
    while at < len(content):
        fields, end, reason = _parse(content, at)
        if fields is not None:
            if why:
                yield why
            why = ""
            yield fields
            at = _blank(content, end)
        else:
            why = why or reason
            spot = content.find(b"WARC/1.", at + 1)
            at = spot if spot >= 0 else len(content)
    if why:
        yield why


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records (``kind`` = record) and quarantined byte ranges (``kind`` = gap, with the reason) of all files at ``path``.

    A file is read by one task, so archives must stay below 2 GB, as the WARC guidelines ask (1 GB).
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("path", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("reason", pa.string()),
            ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()),
            ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()),
        ])
        for batch in batches:
            for path_, content in zip(batch.column("path"), batch.column("content")):
                rows, held = [], 0
                for start, length, item in salvage(content.as_py()):
                    row = {"path": path_.as_py(), "start": start, "length": length}
                    if isinstance(item, str):
                        rows.append(row | {"kind": "gap", "reason": item})
                    else:
                        rows.append(row | {
                            "kind": "record", "record_type": item.get("warc-type"),
                            "record_id": item.get("warc-record-id", "").strip("<>"),
                            "refers_to": item["warc-refers-to"].strip("<>") if "warc-refers-to" in item else None,
                            "target_uri": item.get("warc-target-uri"),
                            "payload_digest": item.get("warc-payload-digest", "").removeprefix("sha1:"),
                            "payload_bytes": item["payload_bytes"], "payload": item["payload"],
                        })
                        held += len(item["payload"] or b"")
                    if held > 4 << 20 or len(rows) >= 4096:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(~F.col("path").rlike("/[_.][^/]*$")).select("path", "content").mapInArrow(parse, READ_SCHEMA)


def key_of(record_id: Column) -> Column:
    """The whole-number key inside a record id of ``write``; null if it was written for a null key."""
    return F.regexp_extract(record_id, r"^urn:record:(-?\d+)$", 1).try_cast("long")
