"""Gradient-boosted regression trees on a bounded numpy sample, for logistic loss; scoring is vectorised over rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    """Trees as arrays of shape (trees, nodes): an inner node sends x[feature] <= threshold to node 2k+1, else to 2k+2."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 50, depth: int = 4, rate: float = 0.2, bins: int = 32, penalty: float = 1.0, share: float = 0.5, seed: int = 0) -> Boosted:
    """Fit by histograms of gradients, each tree on a random share of the rows; every tree is complete, a node that gains nothing sends all rows left.

    Features of two values, most of them flags, are summed for all nodes at once by a matrix product.
    """
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    flag = np.array([len(v) == 2 for v in (np.unique(x[:, j]) for j in range(d))])
    edges = [np.array([x[:, j].min()]) if flag[j] else e for j, e in enumerate(edges)]
    coded = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1).astype(np.int32)
    flags, others = np.flatnonzero(flag), [j for j in np.flatnonzero(~flag) if len(edges[j])]
    raised = coded[:, flags].astype(np.float32)
    inner, total = (1 << depth) - 1, (1 << depth + 1) - 1
    rate0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Boosted(float(np.log(rate0 / (1 - rate0))), np.zeros((trees, total), np.int64), np.full((trees, total), np.inf), np.zeros((trees, total)), depth)
    margin = np.full(n, model.base)
    rng = np.random.default_rng(seed)

    def gains(gs: np.ndarray, hs: np.ndarray, gt: np.ndarray, ht: np.ndarray) -> np.ndarray:
        gain = gs**2 / (hs + penalty) + (gt - gs) ** 2 / (ht - hs + penalty) - gt**2 / (ht + penalty)
        return np.where((hs < 2) | (ht - hs < 2), 0, gain)

    for k in range(trees):
        rows = np.sort(rng.choice(n, int(np.ceil(n * share)), replace=False))
        p = 1 / (1 + np.exp(-margin[rows]))
        g, h = y[rows] - p, np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(len(rows), np.int64)
        code, up = coded[rows], raised[rows]
        for level in range(depth):
            lo, width = (1 << level) - 1, 1 << level
            node = at - lo
            gt, ht = np.bincount(node, g, width)[:, None], np.bincount(node, h, width)[:, None]
            best, feature, cut = np.full(width, 1e-3), np.zeros(width, np.int64), np.full(width, np.inf)
            if len(flags):
                mine = (node[None, :] == np.arange(width)[:, None]).astype(np.float32)
                gain = gains(gt - (mine * g.astype(np.float32)) @ up, ht - (mine * h.astype(np.float32)) @ up, gt, ht)
                j = gain.argmax(axis=1)
                top = gain[np.arange(width), j]
                on = top > best
                best[on], feature[on], cut[on] = top[on], flags[j[on]], [edges[flags[q]][0] for q in j[on]]
            for j in others:
                key = node * bins + code[:, j]
                gs = np.bincount(key, g, width * bins).reshape(width, bins).cumsum(axis=1)
                hs = np.bincount(key, h, width * bins).reshape(width, bins).cumsum(axis=1)
                gain = gains(gs, hs, gt, ht)[:, : len(edges[j])]
                c = gain.argmax(axis=1)
                top = gain[np.arange(width), c]
                on = top > best
                best[on], feature[on], cut[on] = top[on], j, edges[j][c[on]]
            model.feature[k, lo : lo + width], model.threshold[k, lo : lo + width] = feature, cut
            at = 2 * at + 1 + (x[rows, feature[node]] > cut[node])
        leaf = at - inner
        model.value[k, inner:] = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + penalty)
        at = np.zeros(n, np.int64)
        for _ in range(depth):
            at = 2 * at + 1 + (x[np.arange(n), model.feature[k, at]] > model.threshold[k, at])
        margin += model.value[k, at]
    return model
