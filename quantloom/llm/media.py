"""Media columns: texts as PNG images in a binary column, read back chunk by chunk.

Encoding writes 8-bit grey samples as PNG: IHDR, IDAT parts of a zlib stream, IEND, each with its
CRC-32. Decoding tests the signature and every checksum, inflates, undoes the row filters with numpy
and computes a 64-bit hash of the signs of low-frequency cosine-transform coefficients.

Defined cases: a null text is the empty text; an empty text is one row of padding; equal texts give
equal bytes and features; media that is null, cut or damaged gives a row with `media_error` set and
null results; columns other than the id and the text are not read, so they cannot clash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written

WIDTH = 576
PAD = 255
PART = 1 << 15
GRID, LOW = 32, 8
SIGNATURE = b"\x89PNG\r\n\x1a\n"

_k = np.arange(GRID)
COSINES = np.cos(np.pi * (2 * _k[None, :] + 1) * _k[:, None] / (2 * GRID))[: LOW + 1]

ENCODED = "doc_id long, n_bytes long, media binary"
DECODED = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, media_error string"
)


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def padded(text: bytes, width: int = WIDTH) -> bytes:
    rows = max(1, -(-len(text) // width))
    return text + bytes([PAD]) * (rows * width - len(text))


def filtered(image: np.ndarray) -> np.ndarray:
    """Rows with a leading filter byte: of none, left and up, the one of least absolute residuals."""
    left, up = image.copy(), image.copy()
    left[:, 1:] -= image[:, :-1]
    up[1:] -= image[:-1]
    each = np.stack([image, left, up])
    cost = np.abs(each.view(np.int8).astype(np.int16)).sum(axis=2)
    best = cost.argmin(axis=0)
    out = np.empty((image.shape[0], image.shape[1] + 1), np.uint8)
    out[:, 0] = best
    out[:, 1:] = each[best, np.arange(len(best))]
    return out


def encode_png(payload: bytes, width: int = WIDTH, level: int = 3) -> bytes:
    image = np.frombuffer(payload, np.uint8).reshape(-1, width)
    body = zlib.compress(filtered(image).tobytes(), level)
    parts = [chunk(b"IDAT", body[i : i + PART]) for i in range(0, len(body), PART)]
    head = struct.pack(">IIBBBBB", width, image.shape[0], 8, 0, 0, 0, 0)
    return b"".join([SIGNATURE, chunk(b"IHDR", head), *parts, chunk(b"IEND", b"")])


def chunks(media: bytes) -> Iterator[tuple[bytes, bytes]]:
    if media[:8] != SIGNATURE:
        raise ValueError("signature")
    at, kind = 8, b""
    while kind != b"IEND":
        if at + 12 > len(media):
            raise ValueError("cut short")
        size, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + size]
        if len(body) != size or at + 12 + size > len(media):
            raise ValueError("cut short")
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"checksum of {kind.decode('latin-1')}")
        yield kind, body
        at += 12 + size
    if at != len(media):
        raise ValueError("bytes after the end")


def unfiltered(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undoes the five PNG row filters for one byte a sample. Rows of types 0 and 1 are done all at
    once, runs of type 2 by a running sum; types 3 and 4 depend on both neighbours."""
    if kinds.max(initial=0) > 4:
        raise ValueError("filter type")
    out = rows.copy()
    left = kinds == 1
    if left.any():
        out[left] = np.cumsum(rows[left], axis=1, dtype=np.uint8)
    for at in np.flatnonzero(kinds >= 2):
        above = out[at - 1] if at else np.zeros(out.shape[1], np.uint8)
        if kinds[at] == 2:
            out[at] = rows[at] + above
            continue
        line, up = rows[at].tolist(), above.tolist()
        a = c = 0
        for x, b in enumerate(up):
            if kinds[at] == 3:
                guess = (a + b) >> 1
            else:
                near = ((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))
                guess = min(near)[2]
            a = line[x] = (line[x] + guess) & 255
            c = b
        out[at] = line
    return out


def decode_png(media: bytes) -> np.ndarray:
    head, parts = None, []
    for kind, body in chunks(media):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("header")
    width, height = head[:2]
    data = zlib.decompress(b"".join(parts))
    if len(data) != height * (width + 1):
        raise ValueError("size")
    rows = np.frombuffer(data, np.uint8).reshape(height, width + 1)
    return unfiltered(rows[:, 0], rows[:, 1:])


def cosine_hash(image: np.ndarray) -> str:
    """Means over a grid, cosine transform, and for each low frequency whether it exceeds the median."""
    height, width = image.shape
    bands = np.arange(GRID) * height // GRID
    if height >= GRID:
        tall = np.add.reduceat(image, bands, axis=0, dtype=np.int64) / np.diff(np.append(bands, height))[:, None]
    else:
        tall = image[bands].astype(np.float64)
    cols = np.arange(GRID) * width // GRID
    grid = np.add.reduceat(tall, cols, axis=1) / np.diff(np.append(cols, width))
    freq = np.round(COSINES @ grid @ COSINES.T, 6).ravel()[1 : LOW * LOW + 1]
    return np.packbits(freq > np.median(freq)).tobytes().hex()


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        texts = [(x or "").encode() for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array([encode_png(padded(x)) for x in texts], pa.binary())],
            ["doc_id", "n_bytes", "media"],
        )


def described(media: bytes | None) -> tuple:
    if media is None:
        return (None,) * 6 + ("no media",)
    try:
        image = decode_png(media)
    except (ValueError, struct.error, zlib.error) as e:
        return (None, None, None, len(media), hashlib.sha256(media).hexdigest(), None, str(e) or "damaged")
    payload = image.tobytes()
    return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(image), None)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    names = [x.split()[0] for x in DECODED.split(", ")]
    for batch in slices(batches, "media"):
        found = [described(x) for x in batch.column(2).to_pylist()]
        cols = list(zip(*found, strict=True))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and the PNG bytes of each text in the binary column `media`."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_encode, ENCODED)


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same, from a table written to the shared folder: what is read later is the stored bytes."""
    return written(text_media(docs, id_col, text_col), "media")


def media_features(media: DataFrame) -> DataFrame:
    """Reads the stored bytes of `media` (doc_id, n_bytes, media) back; see DECODED for the columns."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_decode, DECODED)
