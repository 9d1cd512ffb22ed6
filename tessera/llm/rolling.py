"""Hashes of all byte strings of a text from prefix sums (polynomial, modulo 2^64)."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE = 0x5851F42D4C957F2D
TABLE = np.random.default_rng(8).integers(0, 1 << 63, 256, dtype=np.uint64)
#: The same with A-Z as a-z.
TABLE_LOWER = TABLE.copy()
TABLE_LOWER[65:91] = TABLE[97:123]
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = 1 << max(16, n.bit_length())
        for name, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, U64(b))
            p[0] = 1
            _POWERS[name] = np.cumprod(p)
    return _POWERS["up"], _POWERS["down"]


def stir(h: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers mixed."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def prefix_sums(data: np.ndarray, table: np.ndarray = TABLE) -> np.ndarray:
    """Sums whose differences hash the strings between two places."""
    up, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(table[data] * up[:len(data)], out=out[1:])
    return out


def between(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the strings from ``start`` to ``end``."""
    return stir((prefix[end] - prefix[start]) * _powers(len(prefix))[1][start])
