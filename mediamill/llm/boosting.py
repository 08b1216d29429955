"""Gradient-boosted regression trees for a two-class logistic loss, on binned features."""

from __future__ import annotations

import numpy as np


class Trees:
    """An ensemble of trees of a fixed depth; each level of a tree is an array of features and bin thresholds."""

    def __init__(self, edges: list[np.ndarray], bias: float, depth: int):
        self.edges, self.bias, self.depth = edges, bias, depth
        self.feature: list[np.ndarray] = []
        self.threshold: list[np.ndarray] = []
        self.value: list[np.ndarray] = []

    def bins(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, dtype=np.uint8)
        for j, e in enumerate(self.edges):
            out[:, j] = np.searchsorted(e, x[:, j], side="right")
        return out

    def _leaf(self, binned: np.ndarray, t: int) -> np.ndarray:
        node = np.zeros(len(binned), dtype=np.int64)
        rows = np.arange(len(binned))
        for _ in range(self.depth):
            f = self.feature[t][node]
            node = 2 * node + 1 + (binned[rows, f] > self.threshold[t][node])
        return node

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        binned = self.bins(x)
        out = np.full(len(x), self.bias)
        for t in range(len(self.value)):
            out += self.value[t][self._leaf(binned, t)]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, rounds: int = 80, depth: int = 4, rate: float = 0.15, least: float = 20.0, ridge: float = 1.0, most_bins: int = 48) -> Trees:
    """Second-order boosting with exact histograms; every split takes the best of all features and bins."""
    weight = np.ones(len(y)) if weight is None else weight
    edges = []
    for j in range(x.shape[1]):
        v = np.unique(x[:, j])
        edges.append((v[1:] + v[:-1]) / 2 if len(v) <= most_bins else np.unique(np.quantile(x[:, j], np.linspace(0, 1, most_bins + 1)[1:-1])))
    p = float(np.average(y, weights=weight))
    model = Trees(edges, float(np.log(max(p, 1e-6) / max(1 - p, 1e-6))), depth)
    binned = model.bins(x)
    width = max(len(e) for e in edges) + 1
    columns = x.shape[1]
    flat = binned.astype(np.int64) + np.arange(columns)[None, :] * width
    score = np.full(len(y), model.bias)
    inner, total = 2**depth - 1, 2 ** (depth + 1) - 1
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-score))
        g, h = weight * (q - y), weight * q * (1 - q)
        feature, threshold = np.zeros(total, dtype=np.int64), np.full(total, 255, dtype=np.int64)
        node = np.zeros(len(y), dtype=np.int64)
        for at in range(inner):
            rows = np.flatnonzero(node == at)
            if len(rows) and h[rows].sum() >= 2 * least * 0.01:
                cells = flat[rows].ravel()
                hg = np.bincount(cells, np.repeat(g[rows], columns), columns * width).reshape(columns, width)
                hh = np.bincount(cells, np.repeat(h[rows], columns), columns * width).reshape(columns, width)
                hn = np.bincount(cells, minlength=columns * width).reshape(columns, width)
                lg, lh, ln = hg.cumsum(1), hh.cumsum(1), hn.cumsum(1)
                sg, sh = g[rows].sum(), h[rows].sum()
                gain = lg**2 / (lh + ridge) + (sg - lg) ** 2 / (sh - lh + ridge) - sg**2 / (sh + ridge)
                gain[(ln < least) | (len(rows) - ln < least)] = -1
                best = int(gain.argmax())
                if gain.flat[best] > 1e-6:
                    feature[at], threshold[at] = best // width, best % width
            go = binned[rows, feature[at]] > threshold[at]
            node[rows] = 2 * at + 1 + go
        value = np.zeros(total)
        sg, sh = np.bincount(node, g, total), np.bincount(node, h, total)
        value[:] = -rate * sg / (sh + ridge)
        model.feature.append(feature)
        model.threshold.append(threshold)
        model.value.append(value)
        score += value[node]
    return model
