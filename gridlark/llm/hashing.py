"""64-bit hashes of many byte strings at once, with numpy.

A string's hash is a sum over its bytes of a random number per byte value times an odd constant to
the power of the byte's place, mixed at the end. It depends on the bytes alone, not on the task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_random = np.random.default_rng(20240607)
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def _places(n: int) -> np.ndarray:
    """Powers of the base up to place ``n``."""
    global _powers
    if n > len(_powers):
        _powers = np.concatenate([[np.uint64(1)], np.full(2 * n, _BASE)]).cumprod(dtype=np.uint64)
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole number."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA3B195354A39B70D)
    return h ^ (h >> np.uint64(32))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each ``data[start:end]``; the strings lie in order, do not overlap, none is empty."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    inside = data if len(place) == len(data) else data[np.repeat(starts, lengths) + place]
    sums = np.add.reduceat(_BYTE[inside] * _places(int(lengths.max()))[place], first)
    return mixed(sums + lengths.astype(np.uint64) * _BASE)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row and their bounds; a null is empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    if texts.type == pa.large_string():
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    size = int(bounds[-1] - bounds[0])
    raw = np.frombuffer(data, np.uint8, size, int(bounds[0])) if size else np.empty(0, np.uint8)
    return raw, bounds - bounds[0]


def slices(bounds: np.ndarray, most_bytes: int) -> list[tuple[int, int]]:
    """Ranges of rows of about ``most_bytes`` together, one row at least."""
    cuts, start = [], 0
    while start < len(bounds) - 1:
        end = int(np.searchsorted(bounds, bounds[start] + most_bytes, "right")) - 1
        end = max(end, start + 1)
        cuts.append((start, end))
        start = end
    return cuts
