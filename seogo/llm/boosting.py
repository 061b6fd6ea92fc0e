"""Gradient-boosted trees for binary targets, on quantile-binned features, in numpy.

Small on purpose: a few thousand rows, some dozens of features, fitted on the driver in a second or
two; the fitted trees are arrays of some kilobytes that tasks receive with their function.
"""

from __future__ import annotations

import numpy as np

TREES, DEPTH, RATE, BINS = 60, 4, 0.2, 32


class BoostedTrees:
    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        f = x.shape[1]
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(f)]
        # rows that fall into the same bins with the same target are one row with a weight
        rows, times = np.unique(np.column_stack([self._bin(x), y.astype(np.int16)]), axis=0, return_counts=True)
        binned, target = rows[:, :-1], rows[:, -1].astype(float)
        rate = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(len(rows), self.base)
        feature, cut, value = [], [], []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, times * (p - target), times * p * (1 - p), times)
            feature.append(tree[0])
            cut.append(tree[1])
            value.append(tree[2])
            score += self._walk(binned, *tree)
        self.trees = np.array(feature), np.array(cut), np.array(value)
        # Platt scaling is fitted by the caller on held-out rows
        self.scale = (1.0, 0.0)

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)]).astype(np.int16)

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray, times: np.ndarray):  # noqa: ANN202
        """One tree as a full binary heap: feature (-1: none), bin cut, value of the leaves. The sums of all nodes of a
        level, by feature and bin, come from one count."""
        inner, (n, f) = 2**DEPTH - 1, b.shape
        feature, cut = np.full(inner, -1), np.zeros(inner, np.int64)
        node, width = np.zeros(n, np.int64), BINS + 1
        slot = np.arange(f)[None] * width + b
        for level in range(DEPTH):
            nodes = 2**level
            at = ((node - (nodes - 1))[:, None] * (f * width) + slot).ravel()
            sums = [np.cumsum(np.bincount(at, np.repeat(x, f), nodes * f * width).reshape(nodes, f, width), 2) for x in (g, h)]
            (lg, lh), (tg, th) = sums, (x[:, :, -1:] for x in sums)
            gain = lg**2 / (lh + 1) + (tg - lg) ** 2 / (th - lh + 1) - tg**2 / (th + 1)
            gain[(lh < 0.5) | (th - lh < 0.5)] = 0
            gain[np.bincount(node - (nodes - 1), times, nodes) < 8] = 0
            best = gain.reshape(nodes, -1).argmax(1)
            good = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-6
            here = slice(nodes - 1, 2 * nodes - 1)
            feature[here], cut[here] = np.where(good, best // width, -1), np.where(good, best % width, 0)
            mine = feature[node]
            node = 2 * node + 1 + ((b[np.arange(n), mine] > cut[node]) & (mine >= 0))
        leaf = node - inner
        lg, lh = np.bincount(leaf, g, 2**DEPTH), np.bincount(leaf, h, 2**DEPTH)
        return feature, cut, -RATE * lg / (lh + 1)

    @staticmethod
    def _walk(b: np.ndarray, feature: np.ndarray, cut: np.ndarray, value: np.ndarray) -> np.ndarray:
        node = np.zeros(len(b), np.int64)
        rows = np.arange(len(b))
        for _ in range(DEPTH):
            f = feature[node]
            node = 2 * node + 1 + ((b[rows, f] > cut[node]) & (f >= 0))
        return value[node - (2**DEPTH - 1)]

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        return self.base + sum(self._walk(b, *t) for t in zip(*self.trees, strict=True))

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        a, c = self.scale
        return 1 / (1 + np.exp(-(a * self.raw(x) + c)))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        self.scale = platt(self.raw(x), y)


def platt(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling of raw scores by Newton steps, to be fitted on held-out rows."""
    a, c = 1.0, 0.0
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * s + c, -30, 30)))
        w, d = p * (1 - p) + 1e-6, p - t
        h = np.array([[(w * s * s).sum() + 1e-3, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, [(d * s).sum(), d.sum()])
        a, c = a - step[0], c - step[1]
    return float(a), float(c)
