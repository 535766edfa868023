"""Media columns: bytes as 8-bit greyscale PNG in a binary column, read back with checks, and
perceptual hashes from low-frequency cosine-transform coefficients.

Writer: rows of WIDTH samples; each row gets the filter (none, sub or up) with the least sum of
absolute signed differences; the filtered rows form one zlib stream, cut into IDAT chunks with a
CRC-32 each. Reader: checks signature, chunk lengths, every CRC-32, the header and the length of the
unpacked stream, and undoes all five filters with numpy.

Defined results: null payloads count as empty; an empty payload is padded to one row of zeros;
equal payloads give equal media; a damaged media value raises MediaError (``read`` turns it
into a row with null features and the reason in ``error``); null media gives nulls and no error;
empty tables give empty results; only the columns named are read, so extra columns can't clash.
Rows are handled one at a time, so memory is bounded by the longest payload and a small batch.
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

from tidewater.llm.common import bounded_batches, lean

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Payload bytes per IDAT chunk, bytes per Arrow batch given back, zlib level.
CHUNK, BATCH, LEVEL = 1 << 16, 8 << 20, 1


class MediaError(ValueError):
    """The stored bytes are not the PNG that was written."""


def pad(payload: bytes, width: int = WIDTH) -> bytes:
    """payload with zeros up to a positive multiple of width."""
    return payload + bytes(-len(payload) % width if payload else width)


def _filtered(rows: np.ndarray) -> np.ndarray:
    """Each row with its filter type in front."""
    n, width = rows.shape
    tries = np.empty((3, n, width), np.uint8)
    tries[0] = rows
    tries[1, :, 0] = rows[:, 0]
    np.subtract(rows[:, 1:], rows[:, :-1], out=tries[1, :, 1:])
    tries[2, 0] = rows[0]
    np.subtract(rows[1:], rows[:-1], out=tries[2, 1:])
    cost = np.minimum(tries, -tries).sum(axis=2, dtype=np.int64)  # |x| of a signed byte
    best = cost.argmin(axis=0)
    out = np.empty((n, width + 1), np.uint8)
    out[:, 0] = best
    out[:, 1:] = tries[best, np.arange(n)]
    return out


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_png(payload: bytes, width: int = WIDTH, level: int = LEVEL) -> bytes:
    """payload must be a positive multiple of width long."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    packed = zlib.compress(_filtered(rows).tobytes(), level)
    header = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    data = [_chunk(b"IDAT", packed[i : i + CHUNK]) for i in range(0, len(packed), CHUNK)]
    return b"".join([SIGNATURE, _chunk(b"IHDR", header), *data, _chunk(b"IEND", b"")])


def _unfiltered(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """rows (changed in place) without their filters."""
    if kinds.max(initial=0) > 4:
        raise MediaError("unknown filter")
    if kinds.max(initial=0) <= 2:
        sub, up = kinds == 1, kinds == 2
        rows[sub] = np.add.accumulate(rows[sub], axis=1, dtype=np.uint8)
        if up.any():
            # a run of up-filtered rows adds to the row before it: a running sum that starts there
            start = np.maximum.accumulate(np.where(up, 0, np.arange(len(rows))))
            total = np.add.accumulate(rows, axis=0, dtype=np.uint8)
            before = np.zeros_like(rows)
            later = start > 0
            before[later] = total[start[later] - 1]
            rows = total - before
        return rows
    above = np.zeros(rows.shape[1], np.uint8)
    for kind, row in zip(kinds.tolist(), rows, strict=True):
        if kind == 1:
            np.add.accumulate(row, out=row, dtype=np.uint8)
        elif kind == 2:
            row += above
        elif kind == 3:
            left = 0
            for x, (v, b) in enumerate(zip(row.tolist(), above.tolist(), strict=True)):
                left = row[x] = (v + (left + b) // 2) & 255
        elif kind == 4:
            left = corner = 0
            for x, (v, b) in enumerate(zip(row.tolist(), above.tolist(), strict=True)):
                to_left, to_up, to_corner = abs(b - corner), abs(left - corner), abs(left + b - 2 * corner)
                near = left if to_left <= to_up and to_left <= to_corner else b if to_up <= to_corner else corner
                left, corner = (v + near) & 255, b
                row[x] = left
        above = row
    return rows


def decode_png(media: bytes) -> np.ndarray:
    """The samples of an 8-bit greyscale PNG without interlacing, as (height, width)."""
    if media[:8] != SIGNATURE:
        raise MediaError("bad signature")
    at, size, data, ended = 8, None, [], False
    while at < len(media) and not ended:
        if at + 12 > len(media):
            raise MediaError("cut chunk")
        length, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + length]
        if at + 12 + length > len(media):
            raise MediaError("cut chunk")
        if struct.unpack_from(">I", media, at + 8 + length)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise MediaError(f"bad checksum of {kind!r}")
        if kind == b"IHDR":
            if size is not None or length != 13:
                raise MediaError("bad header")
            width, height, *form = struct.unpack(">IIBBBBB", body)
            if form != [8, 0, 0, 0, 0] or not width or not height:
                raise MediaError("not 8-bit greyscale")
            size = height, width
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise MediaError(f"unknown critical chunk {kind!r}")
        at += 12 + length
    if size is None or not ended:
        raise MediaError("header or end is missing")
    unpack = zlib.decompressobj()
    want = size[0] * (size[1] + 1)
    try:
        raw = unpack.decompress(b"".join(data), want + 1)
    except zlib.error as e:
        raise MediaError(f"bad stream: {e}") from None
    if len(raw) != want or not unpack.eof:
        raise MediaError("wrong length of stream")
    lines = np.frombuffer(raw, np.uint8).reshape(size[0], size[1] + 1)
    return _unfiltered(lines[:, 0], lines[:, 1:].copy())


def _basis(n: int, k: int = 8) -> np.ndarray:
    """The first k cosine functions on n points."""
    return np.cos(np.pi / n * (np.arange(n) + 0.5)[None, :] * np.arange(k)[:, None])


_SIDE = 32
_ROWS = _basis(_SIDE)
_BASES: dict[int, np.ndarray] = {}


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest cosine coefficients are above their median (the mean's own
    coefficient counts as 0). Rows are averaged into 32 bands first."""
    height, width = samples.shape
    edges = np.arange(_SIDE) * height // _SIDE
    if height >= _SIDE:
        bands = np.add.reduceat(samples, edges, axis=0, dtype=np.int64) / np.diff(edges, append=height)[:, None]
    else:
        bands = samples[edges].astype(np.float64)
    if width not in _BASES:
        _BASES.clear()
        _BASES[width] = _basis(width).T.copy()
    found = np.round(_ROWS @ bands @ _BASES[width], 6).ravel()
    found[0] = 0.0
    return np.packbits(found > np.median(found)).tobytes()


def _encode_batches(width: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, payloads = batch.column(0), batch.column(1)
            rows: list[tuple] = []
            size = start = 0
            for i, value in enumerate(payloads):
                payload = value.as_py() or b""
                media = encode_png(pad(payload, width), width, level)
                rows.append((len(payload), media))
                size += len(media)
                if size >= BATCH or i == len(payloads) - 1:
                    yield pa.record_batch([keys.slice(start, len(rows)), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["key", "n_bytes", "media"])
                    start, rows, size = i + 1, [], 0

    return run


def store(df: DataFrame, payload: str = "text", key: str = "doc_id", width: int = WIDTH, level: int = LEVEL) -> DataFrame:
    """key, n_bytes (of the payload without padding) and media (binary PNG) of every row.
    A string payload is taken as UTF-8."""
    bounded_batches(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(payload).cast("binary").alias("payload")).mapInArrow(lean(_encode_batches(width, level)), f"key {kind}, n_bytes bigint, media binary").withColumnRenamed("key", key)


FEATURES = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, phash binary, error string"


def features(media: bytes) -> tuple:
    """The values of FEATURES."""
    try:
        samples = decode_png(media)
    except MediaError as e:
        return None, None, None, len(media), hashlib.sha256(media).hexdigest(), None, str(e)
    payload = samples.tobytes()
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(samples), None


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
    names = [x.split()[0] for x in FEATURES.split(", ")]
    for batch in batches:
        rows = [features(v.as_py()) if v.is_valid else (None,) * 7 for v in batch.column("media")]
        kept = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "media"]
        yield pa.record_batch([*kept, *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], names=[*[n for n in batch.schema.names if n != "media"], *names])


def read(stored: DataFrame, keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """keep and FEATURES, from the media column's bytes alone."""
    kept = ", ".join(f"{c} {stored.schema[c].dataType.simpleString()}" for c in keep)
    return stored.select(*keep, "media").mapInArrow(lean(_read_batches), f"{kept}, {FEATURES}")
