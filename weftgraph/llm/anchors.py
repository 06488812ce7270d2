"""Anchors of byte windows: positions that equal windows have in common.

A window of ``window`` bytes is represented by the leftmost of its ``GRAM``-byte grams with the smallest hash. Equal
windows choose the same gram at the same offset, so windows can be compared anchor by anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

GRAM = 16
_POS_BITS = 24  # of the ordering key; the other 40 bits come from the gram's hash
_CHUNK = 1 << 17
_LONGEST = 1 << _POS_BITS
_RANDOM = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of each ``GRAM``-byte gram, by doubling."""
    h, size, c = _RANDOM[data], 1, int(_STEP)
    while size < GRAM:
        t = h[:-size] * np.uint64(c)
        t += h[size:]
        h, size, c = t, size * 2, c * c % (1 << 64)
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def packed(texts: list[bytes], window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts packed into chunks: (bytes, owner of each piece, piece bounds). Very long texts come in overlapping pieces."""
    pieces: list[bytes] = []
    owners: list[int] = []
    total = 0
    for i, text in enumerate(texts):
        for a in range(0, max(1, len(text) - window + 1), _LONGEST // 2):
            piece = text[a : a + _LONGEST // 2 + window - 1]
            if total and total + len(piece) > _CHUNK:
                yield _joined(pieces, owners)
                pieces, owners, total = [], [], 0
            pieces.append(piece), owners.append(i)
            total += len(piece)
    if pieces:
        yield _joined(pieces, owners)


def _joined(pieces: list[bytes], owners: list[int]):
    bounds = np.concatenate(([0], np.cumsum([len(p) for p in pieces])))
    return np.frombuffer(b"".join(pieces), np.uint8), np.array(owners, np.int64), bounds


def window_anchors(data: np.ndarray, bounds: np.ndarray, window: int):
    """(piece, key, first start, last start) of each anchor, in order; windows never cross ``bounds``.

    Starts count from the beginning of ``data``; the anchor itself lies inside each of its windows.
    """
    n = len(data) - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none.astype(np.uint64), none, none
    h = gram_hashes(data)
    span = window - GRAM + 1
    low = (h & np.uint64(~(_LONGEST - 1) & (1 << 64) - 1)) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size * 2 <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < span:
        low = np.minimum(low[:n], low[span - size : span - size + n])
    valid = np.ones(n + window, bool)
    valid[n:] = False
    for b in bounds[1:].tolist():
        valid[max(0, b - window + 1) : b] = False
    valid = valid[:n]
    first = valid.copy()
    first[1:] &= (low[1:] != low[:-1]) | ~valid[:-1]
    lo = np.flatnonzero(first)
    last = valid.copy()
    last[:-1] &= (low[1:] != low[:-1]) | ~valid[1:]
    hi = np.flatnonzero(last)
    at = (low[lo] & np.uint64(_LONGEST - 1)).astype(np.int64)
    return np.searchsorted(bounds, lo, "right") - 1, h[at], lo, hi
