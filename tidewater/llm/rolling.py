"""Polynomial hashes of any part of a byte string, from running sums. They depend on the part's bytes alone."""

from __future__ import annotations

import numpy as np

from tidewater.llm import bloom

BASE = np.uint64(0x9E3779B97F4A7C15)
#: A random number for each byte.
TABLE = bloom.mixed(np.arange(256))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """At least n powers of the base, and of its inverse modulo 2**64."""
    if len(_POWERS[0]) <= n:
        size = max(1 << 16, 2 * n)
        for i, factor in enumerate((BASE, np.uint64(pow(int(BASE), -1, 1 << 64)))):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS


class Sums:
    """Running sums over data; ``part`` hashes [start, stop) of it."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(TABLE[data] * up[: len(data)], out=self.sums[1:])

    def part(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.down[start]
