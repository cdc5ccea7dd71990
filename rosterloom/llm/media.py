"""Binary payloads in PNG columns, and low-frequency cosine-transform hashes.

``write_png`` stores each payload losslessly as a 64-pixel-wide RGB image: a
signature, an IHDR chunk, IDAT chunks of a zlib stream and IEND, each chunk with
its CRC.  ``read_png`` parses such a file (any 8-bit grey, RGB or RGBA image
without interlacing), tests every chunk's checksum and the stream's Adler sum,
undoes all five row filters with numpy, and returns the samples with a 64-bit
perceptual hash: the signs, against their median, of the 8 x 8 lowest
frequencies of a 32 x 32 cosine transform.

Defined results: a null or empty payload is stored as one row of spaces; equal
payloads give equal files and hashes; a payload of any length is one image, held
whole by one task; repeated rows each get theirs, also with a null doc_id; broken
files raise ``ValueError``; an empty table gives no rows; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import blocks, bounded_batches, utf8

WIDTH = 64
CHANNELS = 3
ROW_BYTES = WIDTH * CHANNELS
PAD = b" "
IDAT_BYTES = 1 << 16
ZLIB_LEVEL = 1

#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS_BY_COLOUR = {0: 1, 2: 3, 4: 2, 6: 4}
NONE, SUB, UP, AVERAGE, PAETH = range(5)

WRITTEN_SCHEMA = "doc_id long, n_bytes long, png binary"
READ_SCHEMA = "doc_id long, n_bytes long, png binary, width int, height int, payload binary, dct_hash binary"


def padded(payload: bytes) -> bytes:
    """The payload and spaces up to a positive multiple of a row's bytes."""
    return payload.ljust(max(1, -(-len(payload) // ROW_BYTES)) * ROW_BYTES, PAD)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _filtered(rows: np.ndarray) -> tuple[int, np.ndarray]:
    """The filter with the least sum of absolute differences, and its bytes."""
    sub, up = rows.copy(), rows.copy()
    sub[:, CHANNELS:] -= rows[:, :-CHANNELS]
    up[1:] -= rows[:-1]
    choices = {NONE: rows, SUB: sub, UP: up}
    cost = {k: int(np.minimum(x, 0 - x).sum(dtype=np.int64)) for k, x in choices.items()}
    kind = min(cost, key=cost.get)
    return kind, choices[kind]


def encode_png(payload: bytes) -> bytes:
    """A PNG file whose samples are the payload, a multiple of a row's bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES)
    kind, data = _filtered(rows)
    raw = np.empty((len(rows), ROW_BYTES + 1), np.uint8)
    raw[:, 0], raw[:, 1:] = kind, data
    stream = zlib.compress(raw.tobytes(), ZLIB_LEVEL)
    parts = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0))]
    parts += [_chunk(b"IDAT", stream[k : k + IDAT_BYTES]) for k in range(0, len(stream), IDAT_BYTES)]
    return b"".join([*parts, _chunk(b"IEND", b"")])


def chunks(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Type and data of each chunk, tested against its checksum."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at = 8
    while at < len(png):
        if at + 12 > len(png):
            raise ValueError("a chunk is cut short")
        (size,) = struct.unpack_from(">I", png, at)
        kind, data, crc = png[at + 4 : at + 8], png[at + 8 : at + 8 + size], png[at + 8 + size : at + 12 + size]
        if len(crc) != 4 or zlib.crc32(kind + data) != struct.unpack(">I", crc)[0]:
            raise ValueError(f"checksum of chunk {kind!r} differs")
        yield kind, data
        at += 12 + size
        if kind == b"IEND":
            return
    raise ValueError("no IEND chunk")


def _paeth_row(row: np.ndarray, above: np.ndarray, step: int) -> None:
    for k in range(0, len(row), step):
        left = row[k - step : k].astype(np.int16) if k else np.zeros(step, np.int16)
        corner = above[k - step : k].astype(np.int16) if k else np.zeros(step, np.int16)
        up = above[k : k + step].astype(np.int16)
        near = left + up - corner
        a, b, c = abs(near - left), abs(near - up), abs(near - corner)
        guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        row[k : k + step] += guess.astype(np.uint8)


def unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    """Samples of filtered rows (a filter byte first), in runs of one filter.

    None, Sub and Up are undone for a whole run at once, the latter two as
    running sums modulo 256; Average and Paeth depend on the pixel before.
    """
    kinds, rows = raw[:, 0], raw[:, 1:].copy()
    if len(kinds) and kinds.max() > PAETH:
        raise ValueError("unknown row filter")
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for start, stop in zip([0, *edges], [*edges, len(kinds)], strict=True):
        if start == stop:
            continue
        kind, run = kinds[start], rows[start:stop]
        above = rows[start - 1] if start else np.zeros(rows.shape[1], np.uint8)
        if kind == SUB:
            run[:] = np.cumsum(run.reshape(len(run), -1, step), axis=1, dtype=np.uint8).reshape(run.shape)
        elif kind == UP:
            run[0] += above
            run[:] = np.cumsum(run, axis=0, dtype=np.uint8)
        elif kind == AVERAGE:
            for row in run:
                for k in range(0, len(row), step):
                    left = row[k - step : k].astype(np.int16) if k else 0
                    row[k : k + step] += ((left + above[k : k + step].astype(np.int16)) // 2).astype(np.uint8)
                above = row
        elif kind == PAETH:
            for row in run:
                _paeth_row(row, above, step)
                above = row
    return rows


def decode_png(png: bytes) -> np.ndarray:
    """Samples as (height, width, channels)."""
    header, stream = None, []
    for kind, data in chunks(png):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            stream.append(data)
    if header is None or header[2] != 8 or header[3] not in CHANNELS_BY_COLOUR or header[4:] != (0, 0, 0):
        raise ValueError("only 8-bit images without palette or interlacing are read")
    width, height, step = header[0], header[1], CHANNELS_BY_COLOUR[header[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(stream)), np.uint8)
    if raw.size != height * (width * step + 1):
        raise ValueError("the image data has another size than its header says")
    return unfiltered(raw.reshape(height, -1), step).reshape(height, width, step)


_GRID, _LOW = 32, 8
_COSINES = np.cos(np.pi * np.arange(_LOW)[:, None] * (2 * np.arange(_GRID)[None, :] + 1) / (2 * _GRID))


def _resized(grey: np.ndarray, size: int, axis: int) -> np.ndarray:
    """Means of ``size`` even parts along an axis; short axes repeat their samples."""
    n = grey.shape[axis]
    if n < size:
        return np.take(grey, np.arange(size) * n // size, axis=axis)
    edges = np.arange(size) * n // size
    sums = np.add.reduceat(grey, edges, axis=axis)
    counts = np.diff([*edges, n])
    return sums / (counts[:, None] if axis == 0 else counts)


def dct_hash(samples: np.ndarray) -> bytes:
    """Eight bytes: the 8 x 8 lowest frequencies over (1) or not over (0) their median.

    Coefficients are rounded to six decimals first, so that the order of
    additions does not decide a bit.
    """
    grey = _resized(_resized(samples.sum(axis=2, dtype=np.float64), _GRID, 0), _GRID, 1)
    low = np.round(_COSINES @ grey @ _COSINES.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def _write(batches: Iterable[pa.RecordBatch], payload: str) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, payload):
        data = utf8(block.column(payload))
        yield pa.RecordBatch.from_arrays(
            [block.column("doc_id").cast(pa.int64()), pa.array(list(map(len, data)), pa.int64()), pa.array([encode_png(padded(x)) for x in data], pa.binary())],
            names=["doc_id", "n_bytes", "png"],
        )


def write_png(docs: DataFrame, payload: str = "text") -> DataFrame:
    """doc_id, n_bytes and the PNG file of each row's payload (text or binary)."""
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", payload).mapInArrow(lambda it: _write(it, payload), WRITTEN_SCHEMA)


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "png", 1 << 20):
        samples = [decode_png(x) for x in block.column("png").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                *(block.column(c) for c in ("doc_id", "n_bytes", "png")),
                pa.array([x.shape[1] for x in samples], pa.int32()),
                pa.array([x.shape[0] for x in samples], pa.int32()),
                pa.array([x.tobytes() for x in samples], pa.binary()),
                pa.array([dct_hash(x) for x in samples], pa.binary()),
            ],
            names=["doc_id", "n_bytes", "png", "width", "height", "payload", "dct_hash"],
        )


def read_png(media: DataFrame) -> DataFrame:
    """Adds width, height, payload (the samples) and dct_hash to a PNG column."""
    bounded_batches(media.sparkSession)
    return media.select("doc_id", "n_bytes", "png").mapInArrow(_read, READ_SCHEMA)
