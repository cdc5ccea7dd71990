"""WARC archives: segmented writing through Spark's writer, and reassembly on reading.

``write_archives`` makes a record of each page.  The payload goes into an HTTP
response in chunked transfer framing; a block over ``SEGMENT_BYTES`` is cut into a
first record and continuation records.  Of pages with equal payloads of at
least ``REVISIT_BYTES``, the one with the largest id is the response and others
are revisit records without a payload.  Files are written by Spark's text writer,
so the output commits by task and any file system that Spark knows will do.

``read_archives`` parses the files by their Content-Length fields.  Segments are
grouped by the origin's record id, ordered by segment number, joined, and tested
for gaps and against the total length; then the framing is undone and the payload
is tested against its digest.

Defined results: a null payload is empty and always a response; a record written
twice (repeated rows) is read twice; rows with a null id revisit like others and
are the response only if no equal page has an id; a payload of any length
is cut into segments, and joined again by one task; a broken archive raises
``ValueError``; an empty table gives no rows; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches

REVISIT_BYTES = 1000
SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
RECORDS_PER_FILE = 8192
OUTPUT_BYTES = 4 << 20

#: Fixed values of the WARC format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"

_RECORDS = uuid.UUID("7d1b31c5-52c2-4d0e-9a53-0f4b7c1f2c11")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_HTTP_REVISIT = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

PARTS_SCHEMA = "origin string, number int, total long, record_type string, page_id long, refers_to long, url string, digest string, payload_bytes long, block binary"
PAGES_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


# ------------------------------------------------------------------ writing


def _pieces(block: bytes, size: int) -> list[bytes]:
    """Pieces of about ``size`` bytes that do not part a UTF-8 character."""
    parts, at = [], 0
    while at < len(block):
        stop = min(at + size, len(block))
        while stop < len(block) and block[stop] & 0xC0 == 0x80:
            stop += 1
        parts.append(block[at:stop])
        at = stop
    return parts


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in chunked transfer framing; chunks keep characters whole, so that the text stays UTF-8."""
    parts = []
    for piece in _pieces(payload, size):
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body, with any extensions and trailers left out."""
    parts, at = [], 0
    while True:
        stop = body.find(b"\r\n", at)
        if stop < 0:
            raise ValueError("a chunk has no size line")
        size = int(body[at:stop].split(b";")[0], 16)
        if not size:
            return b"".join(parts)
        at = stop + 2 + size
        if body[at : at + 2] != b"\r\n":
            raise ValueError("a chunk is longer or shorter than its size line says")
        parts.append(body[stop + 2 : at])
        at += 2


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_RECORDS, f'{page_id}/{digest}')}>"


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode()
    return b"".join([VERSION, b"\r\n", head, b"Content-Length: %d" % len(block), END, block, END])


def page_records(page_id: int | None, url: str | None, payload: bytes, digest: str, origin: int | None, date: str, segment_bytes: int = SEGMENT_BYTES) -> list[bytes]:
    """The records of one page; ``origin`` is the page that it revisits, if any."""
    own = record_id(page_id, digest)
    clean = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    common = [("WARC-Date", date), ("WARC-Target-URI", clean), ("X-Page-Id", page_id), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", len(payload))]
    http = ("Content-Type", "application/http;msgtype=response")
    if origin is not None:
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, ("WARC-Profile", REVISIT_PROFILE.decode()), ("WARC-Refers-To", record_id(origin, digest)), ("X-Refers-To-Page-Id", origin), http]
        return [_record(fields, _HTTP_REVISIT)]
    block = _HTTP + chunked(payload)
    parts = _pieces(block, segment_bytes)
    first = [("WARC-Type", "response"), ("WARC-Record-ID", own), *common, http]
    if len(parts) == 1:
        return [_record(first, block)]
    records = [_record([*first, ("WARC-Segment-Number", 1)], parts[0])]
    for number, part in enumerate(parts[1:], 2):
        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(page_id, f"{digest}/{number}")), ("WARC-Date", date), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", number)]
        records.append(_record([*fields, ("WARC-Segment-Total-Length", len(block) if number == len(parts) else None)], part))
    return records


def _to_records(batches: Iterable[pa.RecordBatch], date: str, segment_bytes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, held = [], 0
        rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "origin")), batch.column("payload").cast(pa.binary()).to_pylist(), strict=True)
        for page_id, url, digest, origin, payload in rows:
            for record in page_records(page_id, url, payload, digest, origin, date, segment_bytes):
                out.append(record[:-1])  # the writer's line end is the record's last byte
                held += len(record)
            if held >= OUTPUT_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], names=["value"])
                out, held = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], names=["value"])


def with_origins(pages: DataFrame, payload: str, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, digest, and the page that each revisits (null: none).

    Digests are counted before they are shuffled, and only those that occur twice
    meet the pages; Spark splits a digest that many pages share.
    """
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    full = full.withColumn("digest", F.sha1("payload"))
    twice = full.filter(F.octet_length("payload") >= revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("latest"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    joined = full.join(twice, "digest", "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("latest")), F.col("latest")).alias("origin"))


def write_archives(pages: DataFrame, path: str, payload: str = "html", date: str = "2024-01-01T00:00:00Z", segment_bytes: int = SEGMENT_BYTES, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Writes gzip-compressed WARC files of all ``pages`` (page_id, url, payload) below ``path``."""
    bounded_batches(pages.sparkSession)
    lines = with_origins(pages, payload, revisit_bytes).mapInArrow(lambda it: _to_records(it, date, segment_bytes), "value string")
    options = {"lineSep": "\n", "compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": RECORDS_PER_FILE}
    lines.write.options(**options).text(path)


# ------------------------------------------------------------------ reading


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of a WARC stream."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"a record starts with {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise ValueError("a record header is cut short")
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size or stream.read(4) != END:
            raise ValueError("a record is longer or shorter than its header says")
        yield fields, block


def _number(fields: dict[str, str], name: str) -> int | None:
    return int(fields[name]) if name in fields else None


def _arrow(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(f.split() for f in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


def _parse(batches: Iterable[pa.RecordBatch], segmented: bool) -> Iterator[pa.RecordBatch]:
    """Parts of segmented records, or all whole records."""
    for batch in batches:
        for content in batch.column("content"):
            stream: io.BufferedIOBase = io.BytesIO(memoryview(content.as_buffer()))
            if bytes(stream.getbuffer()[:2]) == b"\x1f\x8b":
                stream = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 18)
            rows, held = [], 0
            for fields, block in parse_records(stream):
                kind = fields["warc-type"]
                if kind not in ("response", "revisit", "continuation") or ("warc-segment-number" in fields) != segmented:
                    continue
                digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
                origin = fields.get("warc-segment-origin-id", fields["warc-record-id"])
                rows.append((origin, _number(fields, "warc-segment-number"), _number(fields, "warc-segment-total-length"), kind, _number(fields, "x-page-id"), _number(fields, "x-refers-to-page-id"), fields.get("warc-target-uri"), digest, _number(fields, "x-payload-length"), block))
                held += len(block)
                if held >= OUTPUT_BYTES:
                    yield _arrow(rows, PARTS_SCHEMA)
                    rows, held = [], 0
            yield _arrow(rows, PARTS_SCHEMA)


def join_segments(parts: list[tuple[int, int | None, bytes]]) -> tuple[bytes, int]:
    """Block and number of copies of a record from its segments (number, total length, block) in any order."""
    copies = Counter(number for number, _, _ in parts)
    if set(copies) != set(range(1, len(copies) + 1)) or len(set(copies.values())) != 1:
        raise ValueError("a segment is missing")
    by_number = {number: block for number, _, block in parts}
    block = b"".join(by_number[k] for k in range(1, len(copies) + 1))
    totals = {total for _, total, _ in parts if total is not None}
    if totals != {len(block)}:
        raise ValueError(f"segments hold {len(block)} bytes; the last one says {totals or 'nothing'}")
    return block, copies[1]


def page_payload(record_type: str, block: bytes, digest: str | None) -> bytes | None:
    """The payload of a record's HTTP block, tested against its digest; null for revisits."""
    if record_type == "revisit":
        return None
    head, _, body = block.partition(END)
    payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    if digest is not None and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("a payload differs from its digest")
    return payload


def _page(row: tuple, block: bytes) -> tuple:
    record_type, page_id, refers_to, url, digest, size = row
    payload = page_payload(record_type, block, digest)
    return page_id, url, record_type, refers_to, size if payload is None else len(payload), digest, payload


_FIELDS = ("record_type", "page_id", "refers_to", "url", "digest", "payload_bytes")


def _whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for parts in _parse(batches, segmented=False):
        rows = zip(*(parts.column(c).to_pylist() for c in _FIELDS), strict=True)
        yield _arrow([_page(row, block) for row, block in zip(rows, parts.column("block").to_pylist(), strict=True)], PAGES_SCHEMA)


def _reassemble(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for *row, segments in zip(*(batch.column(c).to_pylist() for c in (*_FIELDS, "segments")), strict=True):
            block, copies = join_segments([(s["number"], s["total"], s["block"]) for s in segments])
            out += [_page(tuple(row), block)] * copies
        yield _arrow(out, PAGES_SCHEMA)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest and payload of every page.

    Only segments are shuffled: whole records are decoded where they are read.
    """
    bounded_batches(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    whole = files.mapInArrow(_whole, PAGES_SCHEMA)
    parts = files.mapInArrow(lambda it: _parse(it, segmented=True), PARTS_SCHEMA)
    first = [F.first(c, ignorenulls=True).alias(c) for c in _FIELDS if c != "record_type"]
    grouped = parts.groupBy("origin").agg(F.lit("response").alias("record_type"), *first, F.collect_list(F.struct("number", "total", "block")).alias("segments"))
    return whole.unionByName(grouped.select(*_FIELDS, "segments").mapInArrow(_reassemble, PAGES_SCHEMA))
