"""Word shingles and MinHash signatures of texts, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_ROLL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64)


def words(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case; bytes methods treat exactly the ASCII letters and the six ASCII blanks so."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; of the whole sequence if it is shorter; none without words."""
    tokens = words(text)
    n = len(tokens)
    if not n:
        return np.zeros(0, np.uint64)
    if n < 5:
        return np.array([xxhash.xxh3_64_intdigest(b"\0".join(tokens))], np.uint64)
    h = word_hashes(tokens)
    x = h[: n - 4] * _ROLL[0]
    for i in range(1, 5):
        x += h[i : n - 4 + i] * _ROLL[i]
    x ^= x >> np.uint64(31)
    x *= _ROLL[0]
    x ^= x >> np.uint64(29)
    return np.unique(x)


class MinHash:
    """Minima of ``n`` universal hash functions a*x + b modulo 2**64 (a odd), of which the upper 32 bits are kept."""

    def __init__(self, n: int, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, n, dtype=np.uint64)

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row of little-endian 32-bit minima for each (non-empty) set."""
        out = np.zeros((len(sets), len(self.a)), "<u4")
        if not sets:
            return out
        x = np.concatenate(sets)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
        h = np.empty_like(x)
        for i, (a, b) in enumerate(zip(self.a, self.b, strict=True)):
            np.multiply(x, a, out=h)
            h += b
            out[:, i] = np.minimum.reduceat(h, starts) >> np.uint64(32)
        return out
