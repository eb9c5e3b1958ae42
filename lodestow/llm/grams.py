"""Hashed byte n-grams of single texts."""

from __future__ import annotations

import numpy as np

_ODD = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)


def counts(data: bytes, widths: tuple[int, ...], bits: int) -> np.ndarray:
    """How many of the text's n-grams of each width fall into each of 2^bits buckets; a text below n bytes counts whole."""
    total, codes = np.zeros(1 << bits, np.int64), np.frombuffer(data, np.uint8).astype(np.uint32)
    if not len(codes):
        return total
    for n in widths:
        k = min(n, len(codes))
        h = np.full(len(codes) - k + 1, n * 0x165667B1 & 0xFFFFFFFF, np.uint32)
        for i in range(k):
            h += codes[i : len(codes) - k + 1 + i] * np.uint32(_ODD[i])
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        total += np.bincount(h >> np.uint32(32 - bits), minlength=1 << bits)
    return total
