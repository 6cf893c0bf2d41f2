"""Content-defined segments: where the windows of a byte string go, so that equal windows meet.

Every window of ``width`` bytes is named by the least hash (leftmost on ties) of its k-byte grams, so equal windows have
the same name at the same offset, wherever they are. Consecutive windows with the same least gram are one segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Odd multiplier of the rolling hash, modulo 2**64.
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and those of its inverse, 0 to n."""
    if len(_POWERS.get(0, ())) <= n:
        size = max(n + 1, 1 << 16)
        for key, base in ((0, _BASE), (1, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def _gram_hashes(x: np.ndarray, k: int) -> np.ndarray:
    up, down = _powers(len(x))
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[: len(x)], out=total[1:])
    h = (total[k:] - total[:-k]) * down[: len(x) - k + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _sliding_least(v: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` consecutive values."""
    n = len(v)
    pad = -n % w
    blocks = np.concatenate((v, np.full(pad, np.iinfo(v.dtype).max, v.dtype))).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def segments(data: np.ndarray, starts: np.ndarray, width: int, k: int, tile: int = 1 << 18) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, first window, windows, name) arrays of the segments of the texts ``data[starts[i]:starts[i + 1]]``.

    Works tile by tile, so memory does not grow with the texts; a segment may be cut where a tile ends.
    """
    low = np.uint64((1 << 20) - 1)
    for a in range(0, max(0, len(data) - width + 1), tile):
        x = data[a : a + tile + width - 1]
        h = _gram_hashes(x, k)
        packed = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        least = _sliding_least(packed, width - k + 1)
        n = len(least)
        where = np.arange(a, a + n)
        text = np.searchsorted(starts, where[[0, -1]], side="right") - 1
        text = np.repeat(np.arange(text[0], text[1] + 1), np.diff(np.clip(starts[text[0] : text[1] + 2], a, a + n)))
        fits = where + width <= starts[text + 1]
        new = np.ones(n, bool)
        new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | (fits[1:] != fits[:-1])
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, n))
        ok = fits[first]
        first, length = first[ok], length[ok]
        yield text[first], where[first] - starts[text[first]], length, h[(least[first] & low).astype(np.int64)]
