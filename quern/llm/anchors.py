"""Content-defined anchors: a sparse set of text positions that equal passages share.

A window of ``width`` bytes is represented by the leftmost ``gram``-byte string
in it whose hash is least.  The choice depends on the window's bytes alone, so
two equal windows have equal anchors at equal offsets, wherever they stand.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20))
_VALUES = _RNG.integers(1, 2**63, size=(2, 256), dtype=np.uint64)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    filled = 1
    while filled < n:
        more = min(filled, n - filled)
        out[filled : filled + more] = out[:more] * np.uint64(pow(base, filled, 1 << 64))
        filled += more
    return out


class Powers:
    """Powers of the two bases and of their inverses, grown on demand."""

    def __init__(self) -> None:
        self.n = 0

    def upto(self, n: int) -> "Powers":
        if n > self.n:
            self.n = max(n, 1 << 19)
            self.up = [_powers(b, self.n) for b in _BASES]
            self.down = [_powers(pow(b, -1, 1 << 64), self.n) for b in _BASES]
        return self


_POWERS = Powers()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """64-bit hashes of any byte range of ``data``, for either of two bases."""

    def __init__(self, data: np.ndarray) -> None:
        self.powers = _POWERS.upto(len(data) + 1)
        self.sums = []
        for which in (0, 1):
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_VALUES[which][data] * self.powers.up[which][: len(data)], out=total[1:])
            self.sums.append(total)

    def of(self, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        total = self.sums[which]
        return mixed((total[end] - total[start]) * self.powers.down[which][start] + (end - start).astype(np.uint64))

    def grams(self, n: int) -> np.ndarray:
        total = self.sums[0]
        return mixed((total[n:] - total[:-n]) * self.powers.down[0][: len(total) - n])


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each p, the first place of the least of ``values[p : p + width]``."""
    least, place, span = values, np.arange(len(values), dtype=np.int32), 1
    while span < width:
        step = min(span, width - span)
        n = len(least) - step
        keep = least[:n] <= least[step:]
        place = np.where(keep, place[:n], place[step:])
        least = np.where(keep, least[:n], least[step:])
        span += step
    return place


def anchors(data: np.ndarray, bounds: np.ndarray, width: int, gram: int, hashes: Hashes | None = None):
    """Anchors of the texts ``data[bounds[i] : bounds[i + 1]]``.

    Returns arrays, an entry for each anchor: the text's number, the anchor's
    place, the first and last start of the windows that it stands for (all
    places in ``data``), and its gram's hash.
    """
    empty = np.empty(0, np.int64)
    if len(data) < width:
        return empty, empty, empty, empty, np.empty(0, np.uint64)
    hashes = hashes or Hashes(data)
    values = hashes.grams(gram)
    place = leftmost_least(values, width - gram + 1)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(place)]
    valid = np.arange(len(place)) + width <= bounds[1:][text]
    starts = np.flatnonzero(valid)
    if not len(starts):
        return empty, empty, empty, empty, np.empty(0, np.uint64)
    at = place[starts].astype(np.int64)
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (text[starts[1:]] != text[starts[:-1]])])
    last = np.r_[new[1:], len(starts)] - 1
    return text[starts[new]], at[new], starts[new], starts[last], values[at[new]]
