"""Hashes of word shingles: words split on ASCII white space, A-Z lower-cased, five words a shingle."""

from __future__ import annotations

import numpy as np

WORDS = 5
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_RANDOM = np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD6E8FEB86659FD93
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) <= n:
        size = max(1 << 16, 1 << (n + 1).bit_length())
        for name, base in (("_powers", _BASE), ("_inverse", pow(_BASE, -1, 1 << 64))):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            globals()[name] = np.multiply.accumulate(step)


def mix(h: np.ndarray, seed: int) -> np.ndarray:
    """Another order of the same hashes."""
    h = (h ^ np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def normal(text: str | None) -> bytes:
    """The words, joined by one space."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split())


def shingle_set(joined: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; one for a text of fewer words, none without words."""
    if not joined:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(joined, np.uint8)
    _grow(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_RANDOM[data] * _powers[: len(data)], out=total[1:])
    gaps = np.flatnonzero(data == 32)
    start = np.concatenate(([0], gaps + 1))
    end = np.append(gaps, len(data))
    if len(start) > WORDS:
        start, end = start[: 1 - WORDS], end[WORDS - 1 :]
    else:
        start, end = start[:1], end[-1:]
    h = (total[end] - total[start]) * _inverse[start]
    return np.unique(mix(h ^ (end - start).astype(np.uint64), 1))
