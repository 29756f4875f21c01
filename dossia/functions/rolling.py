"""Hashes of all windows of bytes, by prefix sums."""

from __future__ import annotations

import numpy as np

CHUNK = 1 << 18
_ODD = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(11)
_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int) -> np.ndarray:
    out = np.full(CHUNK + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


_UP, _DOWN = _powers(_ODD), _powers(pow(_ODD, -1, 2**64))


def windows(data: np.ndarray, width: int):
    """(place of the first, hashes) of the windows of `width` bytes, chunk by chunk; equal windows have equal hashes."""
    step = CHUNK - width + 1
    for at in range(0, len(data) - width + 1, step):
        part = data[at : at + CHUNK]
        n = len(part) - width + 1
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_CODE[part] * _UP[: len(part)], out=sums[1:])
        yield at, (sums[width:] - sums[:n]) * _DOWN[:n]
