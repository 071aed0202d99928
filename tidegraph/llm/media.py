"""Lossless PNG media columns: chunks through zlib, numpy unfiltering, cosine-transform hashes."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .support import byte_groups, map_batches

WIDTH, CHANNELS = 64, 3
ROW = WIDTH * CHANNELS
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SIDE, LOW = 32, 8
GROUP_BYTES = 4 << 20


class MediaError(ValueError):
    """Stored bytes that are not a whole PNG of the kind written here."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def payload_of(raw: bytes) -> bytes:
    """The bytes followed by spaces up to a positive multiple of a pixel row."""
    return raw + b" " * (max(1, -(-len(raw) // ROW)) * ROW - len(raw))


def encode_png(payload: bytes, filter_type: int | None = None, level: int = 6) -> bytes:
    """An 8-bit RGB image 64 pixels wide.

    Each row carries that of the filters 0 (none), 1 (left) and 2 (up) with the least sum of absolute
    differences, the first of equal ones, or the one asked for.
    """
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.empty((len(rows), ROW + 1), np.uint8)
    left, up = rows.copy(), rows.copy()
    left[:, CHANNELS:] -= rows[:, :-CHANNELS]
    up[1:] -= rows[:-1]
    if filter_type is None:
        weight = lambda x: np.minimum(x, -x).sum(axis=1, dtype=np.int64)
        kinds = np.argmin(np.stack([weight(rows), weight(left), weight(up)]), axis=0)
    elif filter_type in (0, 1, 2):
        kinds = np.full(len(rows), filter_type)
    else:
        raise MediaError("the writer knows filters 0 to 2")
    lines[:, 0], lines[:, 1:] = kinds, rows
    for kind, made in ((1, left), (2, up)):
        own = kinds == kind
        lines[own, 1:] = made[own]
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def unfilter(kinds: np.ndarray, data: np.ndarray, step: int) -> np.ndarray:
    """Undo the five row filters: rows with filter 1 at once, runs of filter 2 by sums down the run, the others row by row."""
    out = data.copy()
    if not kinds.any():
        return out
    if kinds.max() > 4:
        raise MediaError(f"unknown row filter {kinds.max()}")
    own = kinds == 1
    if own.any():
        out[own] = np.cumsum(out[own].reshape(own.sum(), -1, step), axis=1, dtype=np.uint8).reshape(own.sum(), -1)
    cuts = np.flatnonzero(np.diff(kinds, prepend=-1, append=-1).astype(bool)) if len(kinds) else []
    for a, b in zip(cuts[:-1], cuts[1:]):
        if kinds[a] == 2:
            begin = max(a - 1, 0)
            out[begin:b] = np.cumsum(out[begin:b], axis=0, dtype=np.uint8)
        elif kinds[a] > 2:
            for i in range(a, b):
                _predicted(out[i], out[i - 1] if i else np.zeros(out.shape[1], np.uint8), int(kinds[a]), step)
    return out


def _predicted(row: np.ndarray, above: np.ndarray, kind: int, step: int) -> None:
    """Undo filter 3 (mean) or 4 (nearest of three) in place."""
    left = np.zeros(step, np.int64)
    corner = np.zeros(step, np.int64)
    for x in range(0, len(row), step):
        up = above[x:x + step].astype(np.int64)
        if kind == 3:
            guess = (left + up) >> 1
        else:
            p = left + up - corner
            a, b, c = abs(p - left), abs(p - up), abs(p - corner)
            guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        left = (row[x:x + step] + guess) & 255
        row[x:x + step] = left
        corner = up


def decode_png(stored: bytes) -> np.ndarray:
    """Samples (height, row bytes) of a stored image; every chunk's checksum is tested."""
    if stored[:8] != SIGNATURE:
        raise MediaError("no PNG signature")
    at, head, body, ended = 8, None, [], False
    while at < len(stored) and not ended:
        if at + 12 > len(stored):
            raise MediaError("cut short")
        (n,) = struct.unpack_from(">I", stored, at)
        kind, data = stored[at + 4:at + 8], stored[at + 8:at + 8 + n]
        if len(data) < n or len(stored) < at + 12 + n:
            raise MediaError("cut short")
        if struct.unpack_from(">I", stored, at + 8 + n)[0] != zlib.crc32(data, zlib.crc32(kind)):
            raise MediaError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            body.append(data)
        ended = kind == b"IEND"
        at += 12 + n
    if head is None or not ended or head[2:] != (8, 2, 0, 0, 0):
        raise MediaError("not an 8-bit RGB image in one pass")
    width, height = head[:2]
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if lines.size != height * (width * CHANNELS + 1):
        raise MediaError("wrong number of samples")
    lines = lines.reshape(height, -1)
    return unfilter(lines[:, 0], lines[:, 1:], CHANNELS)


_BASIS = np.cos(np.pi / SIDE * np.outer(np.arange(LOW), np.arange(SIDE) + 0.5))


def _resize(grey: np.ndarray, side: int) -> np.ndarray:
    """Means over a grid of side x side blocks; short axes repeat rows."""
    for axis in (0, 1):
        n = grey.shape[axis]
        if n < side:
            grey = np.take(grey, np.arange(side) * n // side, axis)
        elif n > side:
            cuts = np.arange(side) * n // side
            sums = np.add.reduceat(grey, cuts, axis)
            counts = np.diff(np.append(cuts, n))
            grey = sums / (counts[:, None] if axis == 0 else counts[None, :])
    return grey


def cosine_hash(samples: np.ndarray) -> str:
    """64 bits: which of the 8 x 8 lowest cosine coefficients of the grey image lie over their median."""
    grey = samples.reshape(len(samples), -1, CHANNELS).sum(2, dtype=np.int64).astype(np.float64)
    low = _BASIS @ _resize(grey, SIDE) @ _BASIS.T
    flat = low.ravel().round(6)
    bits = flat > np.median(flat[1:])
    return np.packbits(bits).tobytes().hex()


def to_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", filter_type: int | None = None, level: int = 6) -> DataFrame:
    """Store each whole text as a PNG: doc_id, n_bytes, media. Null texts are stored as empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in byte_groups(batch, "text", GROUP_BYTES):
                raw = [x.encode() if x else b"" for x in batch.column("text").slice(a, b - a).to_pylist()]
                yield pa.record_batch([batch.column("doc_id").slice(a, b - a), pa.array(map(len, raw), pa.int64()), pa.array([encode_png(payload_of(x), filter_type, level) for x in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    return map_batches(docs.selectExpr(f"cast({doc_id} as long) as doc_id", f"{text} as text"), run, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Read stored images back and describe them.

    Input: doc_id, n_bytes, media. Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (last
    16 payload bytes), media_bytes, media_sha256, feature (the cosine hash in hex). A stored form that is
    damaged raises MediaError; null media give null columns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for stored in batch.column("media"):
                stored = stored.as_py()
                if stored is None:
                    rows.append((None,) * 6)
                    continue
                samples = decode_png(stored)
                payload = samples.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), cosine_hash(samples)))
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.record_batch([batch.column("doc_id"), batch.column("n_bytes"), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return map_batches(media.select("doc_id", "n_bytes", "media"), run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def document_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text stored as an image, read back and described, one row a document; nothing is shuffled.

    Null and empty texts give one row of spaces; a very long text is one tall image; repeated rows give repeated results; an empty table gives
    an empty one; other columns are ignored.
    """
    return media_features(to_media(docs, doc_id, text))
