"""Small helpers for links inside one task: union-find over local places."""

from __future__ import annotations

import numpy as np


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place linked with each of ``n`` places by the links a[i] - b[i]."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = np.minimum(new, new[new])
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return root
        root = new
