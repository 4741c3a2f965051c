"""Correlation of two on-off signals from their runs: the cost follows the number of runs, not of bins.

A signal about its mean is a step function with a step at each run's edges and at its own ends. The correlation of two step
functions is, over the lag, a function whose second difference has a value only at the distances of two edges. So the products
of the steps are added up at those distances within the window, and two running sums give the correlation at every lag; its
value and slope at the window's first lag come from the running integral of one signal at the other's edges.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np


class Signal(NamedTuple):
    """Disjoint half-open runs of bins in order, that don't touch, and the number of bins."""

    starts: np.ndarray
    ends: np.ndarray
    length: int

    @property
    def active(self) -> int:
        return int((self.ends - self.starts).sum())

    @property
    def flat(self) -> bool:
        """Whether every bin is the same, or there is none."""
        return self.active in (0, self.length)


def united(starts: np.ndarray, ends: np.ndarray, length: int) -> Signal:
    """The signal of runs in any order, which may overlap or touch, held to its length."""
    a, b = np.clip(starts, 0, length), np.clip(ends, 0, length)
    a, b = a[b > a], b[b > a]
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    if not len(a):
        return Signal(a.astype(np.int64), b.astype(np.int64), length)
    furthest = np.maximum.accumulate(b)
    new = np.flatnonzero(np.concatenate(([True], a[1:] > furthest[:-1])))
    return Signal(a[new].astype(np.int64), furthest[np.concatenate((new[1:] - 1, [len(a) - 1]))].astype(np.int64), length)


def clipped(signal: Signal, begin: int, size: int) -> Signal:
    """The bins from begin on, as many as size; what lies outside the signal is off."""
    i, j = np.searchsorted(signal.ends, begin, "right"), np.searchsorted(signal.starts, begin + size, "left")
    return Signal(np.maximum(signal.starts[i:j] - begin, 0), np.minimum(signal.ends[i:j] - begin, size), size)


class Tiles(NamedTuple):
    """Equal parts of a signal: the part, start and end of each run within its part, in order."""

    part: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    size: int
    count: int

    @property
    def active(self) -> np.ndarray:
        """Active bins of each part."""
        return np.bincount(self.part, self.ends - self.starts, self.count)

    @property
    def flat(self) -> np.ndarray:
        active = self.active
        return (active == 0) | (active == self.size)


def tiled(signal: Signal, begin: int, size: int, count: int) -> Tiles:
    """Parts of ``size`` bins from begin on; runs are cut at their borders, what lies outside the signal is off."""
    own = clipped(signal, begin, size * count)
    first, n = own.starts // size, (own.ends - 1) // size - own.starts // size + 1
    part = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    starts, ends = np.repeat(own.starts, n) - part * size, np.repeat(own.ends, n) - part * size
    return Tiles(part.astype(np.int64), np.maximum(starts, 0), np.minimum(ends, size), size, count)


def _steps(tiles: Tiles, apart: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts, places (a part's begin at ``apart`` times its number) and sizes of the steps of each part about its mean; nothing beyond its ends."""
    parts, mean = np.arange(tiles.count), tiles.active / tiles.size
    part = np.concatenate((parts, tiles.part, tiles.part, parts))
    at = np.concatenate((np.zeros(tiles.count, np.int64), tiles.starts, tiles.ends, np.full(tiles.count, tiles.size))) + part * apart
    size = np.concatenate((-mean, np.ones(len(tiles.part)), np.full(len(tiles.part), -1.0), mean))
    order = np.argsort(at, kind="stable")
    return part[order], at[order], size[order]


def part_correlations(a: Tiles, b: Tiles, window: int) -> np.ndarray:
    """A row for each part: the normalised correlation of a's and b's about their means for the lags -window to window (a later than b by the lag); zeros where one is flat."""
    apart = max(a.size, b.size) + 2 * window + 2
    of, p, s = _steps(a, apart)
    _, q, r = _steps(b, apart)
    # b about its means and its integral up to any bin: both are zero again at each part's end
    height, area = np.cumsum(r), np.concatenate(([0.0], np.cumsum(np.cumsum(r)[:-1] * np.diff(q))))
    t = p + window
    k = np.searchsorted(q, t, "right") - 1
    first = -np.bincount(of, s * (area[k] + height[k] * (t - q[k])), a.count)
    slope = np.bincount(of, s * height[k], a.count)
    # products of steps at the edges' distances
    low, high = np.searchsorted(q, p - window + 1, "left"), np.searchsorted(q, p + window, "right")
    n = high - low
    other = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    width = 2 * window + 1
    bend = np.bincount(np.repeat(of * width + p + window, n) - q[other], np.repeat(s, n) * r[other], a.count * width).reshape(a.count, width)
    # the rise from one lag to the next, and the value; in one array, as fresh ones of this size cost as much as the sums
    rise = np.cumsum(bend, 1, out=bend)
    np.subtract(slope[:, None], rise, out=rise)
    np.cumsum(rise, 1, out=rise)
    c = np.empty_like(rise)
    c[:, 0] = first
    np.add(first[:, None], rise[:, :-1], out=c[:, 1:])
    power = a.active * (1 - a.active / a.size) * b.active * (1 - b.active / b.size)
    c /= np.sqrt(np.where(power > 0, power, 1.0))[:, None]
    c[a.flat | b.flat] = 0.0
    return c


def correlations(a: Signal, b: Signal, window: int) -> np.ndarray:
    """The same for whole signals, neither of them flat."""
    return part_correlations(tiled(a, 0, a.length, 1), tiled(b, 0, b.length, 1), window)[0]


def peaks(a: Signal, b: Signal, window: int, shoulder: int) -> list[tuple[int, float]]:
    """The lag of the highest correlation and its height, and the same of the highest positive one more than a shoulder away; nothing for flat signals."""
    if a.flat or b.flat:
        return []
    c = correlations(a, b, window)
    best = int(c.argmax())
    found = [(best - window, float(c[best]))]
    far = c.copy()
    far[max(0, best - shoulder) : best + shoulder + 1] = -1.0
    rival = int(far.argmax())
    return found + ([(rival - window, float(far[rival]))] if far[rival] > 0 else [])
