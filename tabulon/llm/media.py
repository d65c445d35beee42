"""Media columns: payloads as PNG files in a binary column, read back with checksum tests, and image hashes.

A payload is stored as one 8-bit grey image, 576 samples wide. The writer chooses for every row the filter
(none, left, up) of least absolute sum. The reader walks the chunks, tests each CRC-32, inflates (which tests the
Adler-32), and undoes all five filter types with numpy: sums along rows or columns where that is enough, and
along anti-diagonals where a sample depends on its neighbours. The feature is a 64-bit hash of the lowest
8 x 8 cosine coefficients of the image, reduced to 32 x 32 by area.

Null and empty texts become 576 padding bytes. Rows are independent: repeated rows give repeated results, an
empty table an empty one, other columns are not read. A damaged file gives null fields and its fault in ``error``.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import reachable
from .common import chunks, tidy

#: Fixed values of the format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples in a row, and the unit to which payloads are padded.
WIDTH = 576
PADDING = b"\xff"
LEVEL = 6
REDUCED, LOW = 32, 8


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def pad(raw: bytes) -> bytes:
    """``raw`` with padding bytes up to a positive multiple of WIDTH."""
    return raw + PADDING * (-len(raw) % WIDTH or (0 if raw else WIDTH))


def write_png(payload: bytes) -> bytes:
    """A grey 8-bit PNG of rows of WIDTH samples."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    left, up = rows.copy(), rows.copy()
    left[:, 1:] -= rows[:, :-1]
    up[1:] -= rows[:-1]
    tried = np.stack([rows, left, up])
    cost = np.abs(tried.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int64)
    best = cost.argmin(axis=0)
    lines = np.empty((len(rows), WIDTH + 1), dtype=np.uint8)
    lines[:, 0] = best
    lines[:, 1:] = tried[best, np.arange(len(rows))]
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def unfilter(lines: np.ndarray, bpp: int) -> np.ndarray:
    """Samples from filtered rows (filter type first); ``bpp``: bytes of a pixel."""
    kinds, data = lines[:, 0], lines[:, 1:]
    if (kinds > 4).any():
        raise ValueError("unknown filter")
    out = data.copy()
    width, at, height = data.shape[1], 0, len(lines)
    while at < height:
        kind, end = kinds[at], at + 1
        while end < height and (kinds[end] == kind or kind > 2 < kinds[end]):
            end += 1
        if kind == 1:
            for c in range(bpp):
                np.add.accumulate(data[at:end, c::bpp], axis=1, dtype=np.uint8, out=out[at:end, c::bpp])
        elif kind == 2:
            np.add.accumulate(data[at:end], axis=0, dtype=np.uint8, out=out[at:end])
            if at:
                out[at:end] += out[at - 1]
        elif kind > 2:
            _diagonals(out, data, kinds, at, end, bpp, width // bpp)
        at = end
    return out


def _diagonals(out: np.ndarray, data: np.ndarray, kinds: np.ndarray, at: int, end: int, bpp: int, pixels: int) -> None:
    """Rows of the average and Paeth filters: pixels of an anti-diagonal don't depend on each other."""
    n = end - at
    full = np.zeros((n + 1, pixels + 1, bpp), dtype=np.int16)
    if at:
        full[0, 1:] = out[at - 1].reshape(pixels, bpp)
    source = data[at:end].reshape(n, pixels, bpp).astype(np.int16)
    average = (kinds[at:end] == 3)[:, None]
    for d in range(n + pixels - 1):
        r = np.arange(max(0, d - pixels + 1), min(n, d + 1))
        c = d - r
        a, b, x = full[r + 1, c], full[r, c + 1], full[r, c]
        p = a + b - x
        pa, pb, px = np.abs(p - a), np.abs(p - b), np.abs(p - x)
        paeth = np.where((pa <= pb) & (pa <= px), a, np.where(pb <= px, b, x))
        full[r + 1, c + 1] = (source[r, c] + np.where(average[r], (a + b) >> 1, paeth)) & 255
    out[at:end] = full[1:, 1:].reshape(n, -1)


def read_png(stored: bytes) -> np.ndarray:
    """Samples (height, width * channels) of an 8-bit PNG without interlace; ValueError if it is damaged."""
    if not stored.startswith(SIGNATURE):
        raise ValueError("no PNG signature")
    at, header, parts, ended = len(SIGNATURE), None, [], False
    while at < len(stored) and not ended:
        if at + 12 > len(stored):
            raise ValueError("chunk cut short")
        size, kind = struct.unpack_from(">I4s", stored, at)
        data = stored[at + 8 : at + 8 + size]
        if len(data) < size or at + 12 + size > len(stored):
            raise ValueError("chunk cut short")
        if struct.unpack_from(">I", stored, at + 8 + size)[0] != zlib.crc32(data, zlib.crc32(kind)):
            raise ValueError(f"checksum of {kind.decode('latin-1')}")
        at += 12 + size
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            parts.append(data)
        elif kind == b"IEND":
            ended = True
    if header is None or not ended:
        raise ValueError("no IHDR or IEND")
    width, height, depth, colour, _, _, interlace = header
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or channels is None or interlace:
        raise ValueError("only 8-bit samples without palette or interlace")
    line = width * channels + 1
    inflate = zlib.decompressobj()
    try:
        raw = inflate.decompress(b"".join(parts), height * line + 1)
    except zlib.error as e:
        raise ValueError(f"zlib: {e}") from None
    if len(raw) != height * line or not inflate.eof:
        raise ValueError("wrong number of samples")
    return unfilter(np.frombuffer(raw, dtype=np.uint8).reshape(height, line), channels)


@functools.lru_cache(maxsize=512)
def _reduction(n: int) -> np.ndarray:
    """REDUCED x n: weights of means over equal areas."""
    edges = np.arange(REDUCED + 1) * (n / REDUCED)
    place = np.arange(n)
    low, high = np.maximum(edges[:-1, None], place), np.minimum(edges[1:, None], place + 1)
    return (np.clip(high - low, 0, None) * (REDUCED / n)).astype(np.float32)


@functools.cache
def _cosines() -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(REDUCED)
    return np.cos(np.pi * (2 * x + 1) * k / (2 * REDUCED))


def cosine_hash(grey: np.ndarray) -> bytes:
    """Eight bytes: which of the lowest coefficients lie above their median (the constant one left out)."""
    small = _reduction(len(grey)) @ grey.astype(np.float32) @ _reduction(grey.shape[1]).T
    low = np.round(_cosines() @ small.astype(np.float64) @ _cosines().T, 3).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, png binary): the padded UTF-8 of each text as a PNG file."""
    reachable(df.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in chunks(batches, "text"):
            texts = [(t or "").encode("utf-8", "replace") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([write_png(pad(t)) for t in texts], pa.binary())], names=["id", "n_bytes", "png"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"id {kind}, n_bytes bigint, png binary").withColumnRenamed("id", id_col)


FIELDS = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, hash binary, error string"


def features(df: DataFrame, media_col: str = "png") -> DataFrame:
    """The columns of ``df`` but the media, and FIELDS read from the stored bytes. Columns of ``df`` with the
    names of FIELDS give way to them; null media give null fields."""
    reachable(df.sparkSession)
    named = {x.split()[0] for x in FIELDS.split(", ")}
    kept = [f for f in df.schema.fields if f.name not in named | {media_col}]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in chunks(batches, media_col):
            rows = []
            for stored in batch.column(media_col).to_pylist():
                if stored is None:
                    rows.append((None,) * 7)
                    continue
                own = len(stored), hashlib.sha256(stored).hexdigest()
                try:
                    samples = read_png(stored)
                    payload = samples.tobytes()
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), *own, cosine_hash(samples), None))
                except ValueError as e:
                    rows.append((None, None, None, *own, None, str(e)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *columns], names=[*(f.name for f in kept), *(x.split()[0] for x in FIELDS.split(", "))])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), FIELDS])
    return df.select(*(F.col(f"`{f.name}`") for f in kept), F.col(media_col)).mapInArrow(tidy(run), schema)
