"""Bloom filters of bounded size, to leave out rows before a shuffle.

They only ever spare work: a row that passes wrongly is dropped by the exact step that follows. Past
MOST_BITS the filter fills up and passes more, so results stay the same at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MOST_BITS, LEAST_BITS, BITS_A_KEY, SEGMENT = 1 << 29, 1 << 19, 20, 1 << 16


def mixed(*columns: np.ndarray) -> np.ndarray:
    """One 64-bit hash of integer columns."""
    out = np.full(len(columns[0]), 0x9E3779B97F4A7C15, np.uint64)
    for c in columns:
        out ^= np.ascontiguousarray(c).astype(np.int64, copy=False).view(np.uint64)
        out ^= out >> np.uint64(30)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(27)
        out *= np.uint64(0x94D049BB133111EB)
        out ^= out >> np.uint64(31)
    return out


def halves(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of 16 bytes as two columns of integers."""
    both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def bits_for(keys: int) -> int:
    bits = LEAST_BITS
    while bits < min(MOST_BITS, keys * BITS_A_KEY):
        bits *= 2
    return bits


def _places(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for shift in (0, 11, 22, 33, 44):
        yield ((hashes >> np.uint64(shift)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) & np.uint64(bits - 1)


def holds(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be among the keys."""
    found = np.ones(len(hashes), bool)
    for at in _places(hashes, len(bitmap) * 8):
        found &= (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


def build(keys: DataFrame, rows: int) -> np.ndarray:
    """The bitmap over the columns of keys (integers, or one of 16 bytes, which counts as two integers); rows: about how
    many there are."""
    bits = bits_for(rows)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            if pa.types.is_binary(batch.schema.field(0).type):
                hashes = mixed(*halves(batch.column(0).to_pylist()))
            else:
                hashes = mixed(*[c.to_numpy(zero_copy_only=False) for c in batch.columns])
            for at in _places(hashes, bits):
                np.bitwise_or.at(bitmap, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        parts = bitmap.reshape(-1, SEGMENT)
        used = np.flatnonzero(parts.any(axis=1))
        for i in used.tolist():
            yield pa.record_batch([pa.array([i], pa.int32()), pa.array([parts[i].tobytes()], pa.binary())], names=["segment", "bytes"])

    def join(group: pa.Table) -> pa.Table:
        joined = np.bitwise_or.reduce([np.frombuffer(b.as_py(), np.uint8) for b in group.column("bytes")])
        return pa.table({"segment": pa.array([group.column("segment")[0].as_py()], pa.int32()), "bytes": pa.array([joined.tobytes()], pa.binary())})

    found = keys.mapInArrow(mark, "segment int, bytes binary").groupBy("segment").applyInArrow(join, "segment int, bytes binary").toArrow()
    bitmap = np.zeros(bits // 8, np.uint8)
    for i, part in zip(found.column("segment").to_pylist(), found.column("bytes").to_pylist(), strict=True):
        bitmap[i * SEGMENT : (i + 1) * SEGMENT] = np.frombuffer(part, np.uint8)
    return bitmap
