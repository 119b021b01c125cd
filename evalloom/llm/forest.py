"""A union-find on numpy arrays, for links found inside one task."""

from __future__ import annotations

import numpy as np


def unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Adds links i-j in place. root[x] is the smallest index joined with x so far."""
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root[:] = up
