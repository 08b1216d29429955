"""Numbers joined by pairs, as labels of touching pixels are."""

from __future__ import annotations

import numpy as np


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of ``n`` numbers that each is joined with by pairs: roots hook to smaller ones, then all paths are made short."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root
