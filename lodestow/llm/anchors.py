"""Content-defined anchors: which places of a text stand for all its windows of a length.

A window of `window` bytes is represented by the leftmost of its `gram`-byte strings with the least hash. Equal windows
have equal representatives at equal offsets, wherever they occur, so repeats can be searched among anchors alone. Runs of
windows with the same anchor are one row; a text has about 2 / (window - gram + 1) of them a byte.
"""

from __future__ import annotations

import numpy as np
import xxhash

_PLACE = 22
#: Windows that are looked at together; longer texts go in pieces.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = np.random.default_rng(11).integers(0, 1 << 64, 256, np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    found = np.full(n, base, np.uint64)
    found[0] = 1
    return np.multiply.accumulate(found)


_UP = _powers(_BASE, 1 << 12)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), 1 << 12)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """What string_hashes takes: sums of data's bytes (uint8), each times a power of its place."""
    global _UP, _DOWN
    if len(data) >= len(_UP):
        n = 2 << len(data).bit_length()
        _UP, _DOWN = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTES[data] * _DOWN[: len(data)], out=sums[1:])
    return sums


def string_hashes(sums: np.ndarray, starts: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
    """64-bit hashes of the strings from starts to before ends; equal strings have equal hashes."""
    h = (sums[ends] - sums[starts]) * _UP[: len(sums)][starts]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every gram-byte string of data."""
    return string_hashes(prefix_sums(data), slice(0, len(data) - gram + 1), slice(gram, len(data) + 1))


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` neighbours, from minima that run forwards and backwards through blocks."""
    n = len(keys)
    full = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = keys
    blocks = full.reshape(-1, width)
    forwards = np.minimum.accumulate(blocks, axis=1).ravel()
    backwards = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backwards[: n - width + 1], forwards[width - 1 : n])


def least_places(h: np.ndarray, width: int) -> np.ndarray:
    """The places of the leftmost least hash of every `width` neighbours, ascending; long rows go in pieces."""
    found = []
    for piece in range(0, len(h) - width + 1, PIECE):
        part = h[piece : piece + PIECE + width - 1]
        keys = (part >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(part), dtype=np.uint64)
        found.append(np.unique(_least(keys, width) & np.uint64((1 << _PLACE) - 1)).astype(np.int64) + piece)
    return np.unique(np.concatenate(found))


def anchors(text: bytes, window: int, gram: int) -> list[tuple[int, int, int, int, int]]:
    """(gram hash, context hash, anchor, first window, last window) of each run; hashes as signed longs, places in text.

    The context is all bytes of the run's windows.
    """
    found = []
    for piece in range(0, len(text) - window + 1, PIECE):
        data = np.frombuffer(text, np.uint8)[piece : piece + PIECE + window - 1]
        h = gram_hashes(data, gram)
        keys = (h >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(h), dtype=np.uint64)
        at = (_least(keys, window - gram + 1) & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
        starts = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
        ends = np.concatenate((starts[1:] - 1, [len(at) - 1]))
        for a, b, m, g in zip((starts + piece).tolist(), (ends + piece).tolist(), (at[starts] + piece).tolist(), h[at[starts]].view(np.int64).tolist()):
            c = xxhash.xxh3_64_intdigest(text[a : b + window])
            found.append((g, c - (c >> 63 << 64), m, a, b))
    return found
