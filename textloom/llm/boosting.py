"""Gradient-boosted oblivious trees in numpy: logistic loss, histograms, one test per level."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    edges: list[np.ndarray]  # per feature: upper edges of its bins
    features: np.ndarray  # trees x depth
    cuts: np.ndarray  # trees x depth, as values
    leaves: np.ndarray  # trees x 2^depth
    base: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out = np.full(len(x), self.base)
        for f, c, leaf in zip(self.features, self.cuts, self.leaves):
            at = np.zeros(len(x), np.int64)
            for k in range(len(f)):
                at |= (x[:, f[k]] > c[k]).astype(np.int64) << k
            out += leaf[at]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 50, depth: int = 4, rate: float = 0.3, bins: int = 16, smooth: float = 2.0) -> Boosted:
    """Trees for labels y of 0 and 1. The first-best test per level, over all leaves at once."""
    n, m = x.shape
    w = np.ones(n) if weight is None else weight
    edges, codes = [], np.empty((m, n), np.int64)  # a row per feature, so that histograms read it in one go
    for j in range(m):
        e = np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="nearest")) if n else np.zeros(0)
        values = np.unique(x[:, j])
        if len(values) <= bins:
            e = values[:-1]
        edges.append(e)
        codes[j] = np.searchsorted(e, x[:, j], side="left")
    width = bins + 1
    rate_of = np.clip((w * y).sum() / max(w.sum(), 1e-9), 1e-3, 1 - 1e-3)
    base = float(np.log(rate_of / (1 - rate_of)))
    margin = np.full(n, base)
    used_f, used_c, used_l = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (y - p), w * p * (1 - p)
        leaf = np.zeros(n, np.int64)
        fs, cs = [], []
        for k in range(depth):
            best = (-np.inf, 0, 0)
            size = 1 << k
            base_key = leaf * width
            for j in range(m):
                if not len(edges[j]):
                    continue
                key = base_key + codes[j]
                gs = np.bincount(key, g, size * width).reshape(size, width).cumsum(axis=1)
                hs = np.bincount(key, h, size * width).reshape(size, width).cumsum(axis=1)
                gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = (gl**2 / (hl + smooth) + (gt - gl) ** 2 / (ht - hl + smooth)).sum(axis=0)[: len(edges[j])]
                c = int(gain.argmax())
                if gain[c] > best[0] + 1e-9:
                    best = (gain[c], j, c)
            _, j, c = best
            fs.append(j)
            cs.append(edges[j][c] if len(edges[j]) else np.inf)
            leaf |= (codes[j] > c).astype(np.int64) << k
        gs = np.bincount(leaf, g, 1 << depth)
        hs = np.bincount(leaf, h, 1 << depth)
        value = rate * gs / (hs + smooth)
        margin += value[leaf]
        used_f.append(fs), used_c.append(cs), used_l.append(value)
    return Boosted(edges, np.array(used_f), np.array(used_c), np.array(used_l), base)
