"""Hashes of words and word shingles, as numpy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def words(raw: bytes) -> list[bytes]:
    """Runs of anything but the six ASCII white-space characters (what ``bytes.split`` splits at)."""
    return raw.split()


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    out = np.empty(n, np.uint64)
    if n:
        out[0] = 1
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits evenly (multiply, shift, xor)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each ``k`` consecutive words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(len(hashes)), out=total[1:])
    return mixed((total[k:] - total[:n]) * powers(n, _INVERSE))


def shingle_set(found: list[bytes], k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles; of the whole sequence if it is shorter."""
    if not found:
        return np.empty(0, np.uint64)
    h = word_hashes(found)
    if len(h) >= k:
        return np.unique(windows(h, k))
    return windows(h, len(h)) ^ np.uint64(len(h))
