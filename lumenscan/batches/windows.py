"""Running sums, neighbours and newest rows over arrays, as ``functions.windows`` has them over rows."""

from __future__ import annotations

import numpy as np


def chosen(values: np.ndarray, at: np.ndarray, otherwise: int) -> np.ndarray:
    """``values`` at the rows ``at``; a row below zero is none."""
    if not len(values):
        return np.full(len(at), otherwise)
    return np.where(at >= 0, values[at], otherwise)


class Window:
    """Rows taken in ``order`` (None: as they are), in runs whose ``keys`` agree.

    All arrays that come in and go out are in the rows' own order, and rows are named by it.
    """

    def __init__(self, order: np.ndarray | None, *keys: np.ndarray):
        self.order, size = order, len(keys[0])
        self.is_first = np.zeros(size, bool)
        self.is_first[:1] = True
        for key in keys:
            key = self._in(key)
            self.is_first[1:] |= key[1:] != key[:-1]
        starts = np.flatnonzero(self.is_first)
        self.first = np.repeat(starts, np.diff(np.append(starts, size)))
        self.is_last = np.append(self.is_first[1:], True)[:size]
        self.index = np.arange(size)

    def _in(self, x: np.ndarray) -> np.ndarray:
        return x if self.order is None else x[self.order]

    def _out(self, x: np.ndarray) -> np.ndarray:
        if self.order is None:
            return x
        out = np.empty_like(x)
        out[self.order] = x
        return out

    def total(self, x: np.ndarray) -> np.ndarray:
        """Sum of ``x`` up to and including each row."""
        x = self._in(x).astype(np.int64)
        sums = np.cumsum(x)
        return self._out(sums - (sums - x)[self.first])

    def newest(self, when: np.ndarray, before: bool = False) -> np.ndarray:
        """The newest row that satisfies ``when``, or -1; with ``before`` the row itself does not count."""
        at = np.maximum.accumulate(np.where(self._in(when), self.index, -1))
        at = np.where(at >= self.first, at, -1)
        if before:
            at = np.append(-1, at[:-1])[: len(at)]
            at[self.is_first] = -1
        if self.order is not None:
            at = chosen(self.order, at, -1)
        return self._out(at)

    def lag(self, x: np.ndarray, otherwise: int) -> np.ndarray:
        out = self._in(x)
        out = np.append(out[:1], out[:-1])
        out[self.is_first] = otherwise
        return self._out(out)

    def lead(self, x: np.ndarray, otherwise: int) -> np.ndarray:
        out = self._in(x)
        out = np.append(out[1:], out[-1:])
        out[self.is_last] = otherwise
        return self._out(out)

    def least_before(self, x: np.ndarray) -> np.ndarray:
        """The least ``x`` above each row, or 0; only for windows in the rows' own order."""
        if not len(x):
            return x
        # Each run is moved below all runs ahead of it, so that their values cannot win.
        down = np.cumsum(self.is_first) * (int(x.max()) - int(x.min()) + 1)
        low = np.minimum.accumulate(x - down) + down
        low = np.append(0, low[:-1])
        low[self.is_first] = 0
        return low


def sorted_by(*keys: np.ndarray, tie: np.ndarray | None = None) -> np.ndarray:
    """The order by ``keys``, the first one first; ties as the rows are, or by ``tie``."""
    if tie is not None:
        return np.lexsort((tie, *reversed(keys)))
    key = np.zeros(len(keys[0]), np.int64)
    if not len(key):
        return key
    width = 1
    for part in keys:
        width *= int(part.max()) - int(part.min()) + 1
    if width >= 1 << 62:
        return np.lexsort(tuple(reversed(keys)))
    for part in keys:
        low = int(part.min())
        key = key * (int(part.max()) - low + 1) + (part - low)
    return np.argsort(key, kind="stable")
