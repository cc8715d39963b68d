"""Statistics of all pairs of one long series without the pairs: inversions by merge counting, slopes by selection."""

from __future__ import annotations

import numpy as np

#: Up to this many values the pairs fit a small array, and taking them all is the shorter way to the same numbers.
FEW = 300
#: Pairs drawn to bracket a slope.
DRAWN = 20_000


def _levels(order: np.ndarray):
    """The levels of a merge sort of the whole numbers ``order``: per level the sorted left and right halves and their places.

    Yields ``left, right, at, half``: values of the left halves end to end (blocks apart by an offset), those of the right
    ones, how many of its block's left values are below each right one or equal to it, and the length of a half.
    """
    n = len(order)
    size = 1 << max(1, (n - 1).bit_length())
    values = np.full(size, int(order.max(initial=0)) + 1, np.int64)  # what fills up is above all: no inversion
    values[:n] = order
    step = int(values.max()) + 1
    half = 1
    while half < size:
        blocks = values.reshape(-1, 2 * half)
        offset = np.arange(len(blocks), dtype=np.int64)[:, None] * step
        left, right = (blocks[:, :half] + offset).ravel(), (blocks[:, half:] + offset).ravel()
        at = np.searchsorted(left, right, "right") - np.repeat(np.arange(len(blocks)) * half, half)
        yield left, right, at, half, offset
        values = np.sort(blocks, axis=1).ravel()
        half *= 2


def inversions(order: np.ndarray) -> int:
    """Pairs of which the later one is smaller."""
    if len(order) < 2:
        return 0
    return sum(int((half - at).sum()) for _, _, at, half, _ in _levels(order))


def inverted_pairs(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all pairs of which the later one is smaller (the values must be different)."""
    first, second = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for left, right, at, half, offset in _levels(order):
        above = half - at
        if not above.any():
            continue
        block = np.repeat(np.arange(len(offset)), half)
        since = np.arange(above.sum()) - np.repeat(np.cumsum(above) - above, above)
        where = np.repeat(block * half + at, above) + since
        first.append(left[where] - np.repeat(offset.ravel()[block], above))
        second.append(np.repeat(right - offset.ravel()[block], above))
    return np.concatenate(first), np.concatenate(second)


def kendall_s(y: np.ndarray) -> float:
    """Rising less falling pairs of values in order of time."""
    if len(y) <= FEW:
        later, earlier = np.tril_indices(len(y), -1)
        return float(np.sign(y[later] - y[earlier]).sum())
    values, rank, count = np.unique(y, return_inverse=True, return_counts=True)
    n = len(y)
    tied = int((count.astype(np.int64) * (count - 1) // 2).sum())
    return float(n * (n - 1) // 2 - tied - 2 * inversions(rank))


class Slopes:
    """Order statistics of the slopes of all pairs of points; ``x`` rises strictly.

    A slope is at most ``s`` where the line of that slope through the earlier point passes above the later one, so
    counting slopes is counting inversions of ``y - s x``.  Slopes of some drawn pairs bracket the one that is looked for;
    those inside the bracket are the pairs whose order differs between its two ends, and only they are listed.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray):
        if not (np.diff(x) > 0).all():
            raise ValueError("a series has two values at one time")
        self.x, self.y = x - x.mean(), y - y.mean()
        self.raw = x, y
        self.n = len(x)
        self.pairs = self.n * (self.n - 1) // 2
        rng = np.random.default_rng(0)
        i, j = rng.integers(0, self.n, (2, DRAWN))
        i, j = np.minimum(i, j)[i != j], np.maximum(i, j)[i != j]
        self.drawn = np.unique((y[j] - y[i]) / (x[j] - x[i]))
        self.fuzz = 2.0 ** -48 * np.array([np.abs(self.y).max(), np.abs(self.x).max()]) / np.diff(x).min()

    def _order(self, s: float) -> np.ndarray:
        """Points so sorted that a later point comes before an earlier one if their slope is at most ``s``."""
        if np.isinf(s):
            return np.arange(self.n) if s < 0 else np.arange(self.n)[::-1]
        return np.lexsort((-np.arange(self.n), self.y - s * self.x))

    def _at_most(self, s: float) -> int:
        return inversions(self._order(s)) if np.isfinite(s) else self.pairs if s > 0 else 0

    def _beside(self, s: float, side: int) -> float:
        """A slope so far beside ``s`` that rounding does not put ``s`` on its other side."""
        return s + side * float(self.fuzz[0] + abs(s) * self.fuzz[1] + np.spacing(abs(s)))

    def _inside(self, low: float, high: float) -> np.ndarray:
        """The slopes above ``low`` and up to ``high``, sorted."""
        before, after = self._order(low), self._order(high)
        place = np.empty(self.n, np.int64)
        place[after] = np.arange(self.n)
        a, b = inverted_pairs(place[before])
        i, j = after[a], after[b]
        x, y = self.raw
        return np.sort((y[j] - y[i]) / (x[j] - x[i]))

    def smallest(self, k: int) -> float:
        """The ``k``-th smallest slope, counted from 1."""
        a, b = 0, len(self.drawn)  # the first drawn slope that is not below the one looked for
        while a < b:
            middle = (a + b) // 2
            if self._at_most(self._beside(self.drawn[middle], 1)) >= k:
                b = middle
            else:
                a = middle + 1
        low = self._beside(self.drawn[a - 1], 1) if a else -np.inf
        high = np.inf
        if a < len(self.drawn):
            below = self._beside(self.drawn[a], -1)
            if below <= low or self._at_most(below) < k:
                # Many pairs may have this very slope; then there is nothing to list.
                low, high = max(low, below), self._beside(self.drawn[a], 1)
                if self._at_most(high) - self._at_most(low) > 10 * self.n:
                    return float(self.drawn[a])
            else:
                high = below
        fewer = self._at_most(low)
        while self._at_most(high) - fewer > 10 * self.n and np.isfinite(low) and np.isfinite(high):
            middle = low + (high - low) / 2
            if not low < middle < high:
                return high
            if (count := self._at_most(middle)) >= k:
                high = middle
            else:
                low, fewer = middle, count
        return float(self._inside(low, high)[k - fewer - 1])
