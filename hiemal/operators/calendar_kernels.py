"""Windows of a packed calendar in numpy: pooled ordered samples and pooled moments of every slot."""
from __future__ import annotations

import numpy as np

CELLS = 1 << 24  # of the membership table of slots and values at a time


class Samples:
    """Ordered samples of some slots, one behind the other: ``x`` and ``year`` of all, ``n`` of each slot."""

    def __init__(self, slots: np.ndarray, n: np.ndarray, x: np.ndarray, year: np.ndarray):
        self.slots, self.n, self.x, self.year = slots, n, x, year
        self.start = np.cumsum(n) - n

    def without(self, year: int) -> Samples:
        kept = self.year != year
        owner = np.repeat(np.arange(len(self.n)), self.n)
        return Samples(self.slots, np.bincount(owner[kept], minlength=len(self.n)), self.x[kept], self.year[kept])

    def years(self) -> np.ndarray:
        """Number of distinct years of each slot."""
        if not len(self.x):
            return np.zeros(len(self.n), np.int64)
        names, place = np.unique(self.year, return_inverse=True)
        seen = np.zeros((len(self.n), len(names)), bool)
        seen[np.repeat(np.arange(len(self.n)), self.n), place] = True
        return seen.sum(axis=1)

    def at(self, place: np.ndarray) -> np.ndarray:
        """The value at a 0-based place of each sample; of an empty one NaN."""
        if not len(self.x):
            return np.full(len(self.n), np.nan)
        inside = np.clip(place, 0, np.maximum(self.n - 1, 0))
        return np.where(self.n > 0, self.x[np.minimum(self.start + inside, len(self.x) - 1)], np.nan)

    def interpolated(self, h: np.ndarray) -> np.ndarray:
        """Linear interpolation at 1-based fractional places, clamped to the ends."""
        h = np.maximum(1.0, np.minimum(h, self.n.astype(float)))
        lo = np.floor(h).astype(np.int64)
        low = self.at(lo - 1)
        return low + (h - lo) * (self.at(np.minimum(lo + 1, self.n) - 1) - low)

    def median_unbiased(self, p: float) -> np.ndarray:
        return self.interpolated((self.n + 1.0 / 3.0) * p + 1.0 / 3.0)

    def linear(self, p: float) -> np.ndarray:
        return self.interpolated((self.n - 1.0) * p + 1)

    def median(self) -> np.ndarray:
        return (self.at((self.n - 1) // 2) + self.at(self.n // 2)) / 2

    def departures(self, centre: np.ndarray) -> Samples:
        """Ordered absolute departures from one number of each slot."""
        owner = np.repeat(np.arange(len(self.n)), self.n)
        d = np.abs(self.x - centre[owner])
        return Samples(self.slots, self.n, d[np.lexsort((d, owner))], self.year)


def pooled(slot: np.ndarray, x: np.ndarray, year: np.ndarray, half: int, period: int):
    """``Samples`` of all slots with values within ``half`` slots around, some slots at a time."""
    order = np.argsort(x, kind="stable")
    slot, x, year = slot[order], x[order], year[order]
    step = max(1, CELLS // max(1, len(x)))
    for first in range(1, period + 1, step):
        slots = np.arange(first, min(first + step, period + 1))
        away = np.abs(slots[:, None] - slot[None, :].astype(np.int32))
        member = np.minimum(away, period - away) <= half
        n = member.sum(axis=1)
        places = np.flatnonzero(member) % max(1, len(x))
        some = n > 0
        yield Samples(slots[some], n[some], x[places], year[places])


def merged_moments(n: np.ndarray, s: np.ndarray, q: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, sum and sum of squared departures of the windows of calendars (series x slots), merged slot by slot."""
    a = [np.zeros_like(n) for _ in range(3)]
    with np.errstate(divide="ignore", invalid="ignore"):
        for o in range(-half, half + 1):
            pn, ps, pq = (np.roll(v, -o, axis=1) for v in (n, s, q))
            d = ps / pn - a[1] / a[0]
            apart = np.where((a[0] > 0) & (pn > 0), d * d * a[0] * pn / (a[0] + pn), 0.0)
            a = [a[0] + pn, a[1] + ps, a[2] + pq + apart]
    return tuple(a)
