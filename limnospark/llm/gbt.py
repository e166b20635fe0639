"""Gradient-boosted trees for a binary label: logistic loss, quantile bins,
depth-limited trees grown level by level. Fits in memory on a bounded sample;
prediction is vectorised over rows."""

from __future__ import annotations

import numpy as np

from .common import ship

ship(__name__)


class Trees:
    def __init__(self, cuts: list[np.ndarray], base: float):
        self.cuts, self.base, self.trees = cuts, base, []

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], 1).astype(np.uint8)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = np.full(len(b), self.base)
        row = np.arange(len(b))
        for depth, feature, at, leaf in self.trees:
            node = np.zeros(len(b), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (b[row, feature[node]] > at[node])
            out += leaf[node - (2 ** depth - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 5, rate: float = 0.2, n_bins: int = 32, least: float = 4.0) -> Trees:
    cuts = []
    for j in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins + 1)[1:-1]))
        cuts.append(q)
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    model = Trees(cuts, float(np.log(share / (1 - share))))
    b = model.bins(x).astype(np.int64)
    f, width = x.shape[1], n_bins + 1
    z = np.full(len(y), model.base)
    flat = b + np.arange(f) * width
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        feature, at = np.zeros(2 ** depth - 1, np.int64), np.full(2 ** depth - 1, 255, np.int64)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, count = 2 ** level - 1, 2 ** level
            own = (node - first)[:, None] * (f * width) + flat
            gs = np.bincount(own.ravel(), np.repeat(g, f), minlength=count * f * width).reshape(count, f, width).cumsum(2)
            hs = np.bincount(own.ravel(), np.repeat(h, f), minlength=count * f * width).reshape(count, f, width).cumsum(2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs ** 2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt ** 2 / (ht + 1)
            gain[(hs < least) | (ht - hs < least)] = 0
            best = gain.reshape(count, -1).argmax(1)
            ok = gain.reshape(count, -1)[np.arange(count), best] > 1e-6
            feature[first:first + count] = np.where(ok, best // width, 0)
            at[first:first + count] = np.where(ok, best % width, 255)
            node = 2 * node + 1 + (b[np.arange(len(y)), feature[node]] > at[node])
        leaf_of = node - (2 ** depth - 1)
        gl, hl = np.bincount(leaf_of, g, minlength=2 ** depth), np.bincount(leaf_of, h, minlength=2 ** depth)
        leaf = rate * gl / (hl + 1)
        z += leaf[leaf_of]
        model.trees.append((depth, feature, at, leaf))
    return model
