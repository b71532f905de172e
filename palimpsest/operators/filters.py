"""Hash filters: a bounded set of hashes that executors hold, to leave out what can't be in it."""

from __future__ import annotations

import numpy as np

#: Hashes of one filter (64 MB of bits at most), and bits for each: under 0.1 % of other hashes pass.
BLOCK, BITS = 4_000_000, 64


def _probes(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    other = (h >> np.uint64(27)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)
    return (h & np.uint64(size - 1)).astype(np.int64), (other & np.uint64(size - 1)).astype(np.int64)


def filter_of(hashes: np.ndarray) -> np.ndarray:
    """Two bits a hash in a power of two of bits, at least BITS a hash."""
    size = 1 << max(10, (len(hashes) * BITS - 1).bit_length())
    bits = np.zeros(size // 8, np.uint8)
    for b in _probes(hashes, size):
        np.bitwise_or.at(bits, b >> 3, np.uint8(1) << (b & 7).astype(np.uint8))
    return bits


def passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes may be in the filter; those that are in it always pass."""
    one, two = _probes(h, len(bits) * 8)
    first = np.flatnonzero((bits[one >> 3] >> (one & 7).astype(np.uint8)) & 1)
    two = two[first]
    out = np.zeros(len(h), bool)
    out[first[(bits[two >> 3] >> (two & 7).astype(np.uint8)) & 1 > 0]] = True
    return out
