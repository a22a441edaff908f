"""Gradient-boosted trees for the logistic loss on binned dense features, and isotonic regression; numpy alone."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    feature: np.ndarray  # -1 at leaves
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            f = self.feature[at]
            go = f >= 0
            if not go.any():
                return self.value[at]
            rows = np.flatnonzero(go)
            less = x[rows, f[rows]] <= self.threshold[at[rows]]
            at[rows] = np.where(less, self.left[at[rows]], self.right[at[rows]])


@dataclass
class BoostedTrees:
    rounds: int = 60
    depth: int = 3
    rate: float = 0.15
    bins: int = 32
    least_leaf: float = 2.0  # hessian
    l2: float = 1.0
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> BoostedTrees:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        # a value of its own gets a bin of its own, as counts are mostly zero
        edges = [np.unique(np.concatenate((e, np.unique(x[:, f])[: self.bins]))) for f, e in enumerate(edges)]
        binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
        share = np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        z = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            tree = self._grow(binned, edges, weight * (p - y), weight * p * (1 - p))
            self.trees.append(tree)
            z += tree.predict(x)
        return self

    def _grow(self, binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> Tree:
        nodes: list[list] = []

        def build(rows: np.ndarray, depth: int) -> int:
            gs, hs = g[rows].sum(), h[rows].sum()
            k = len(nodes)
            nodes.append([-1, 0.0, -1, -1, -self.rate * gs / (hs + self.l2)])
            if depth == 0 or hs < 2 * self.least_leaf:
                return k
            best, parent = (1e-6, -1, -1), gs * gs / (hs + self.l2)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[rows, f]
                gl = np.cumsum(np.bincount(b, g[rows], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, h[rows], len(e) + 1))[:-1]
                ok = (hl >= self.least_leaf) & (hs - hl >= self.least_leaf)
                gain = np.where(ok, gl**2 / (hl + self.l2) + (gs - gl) ** 2 / (hs - hl + self.l2) - parent, -1.0)
                j = int(gain.argmax())
                if gain[j] > best[0]:
                    best = (float(gain[j]), f, j)
            _, f, j = best
            if f < 0:
                return k
            less = binned[rows, f] <= j
            nodes[k][:2] = [f, float(edges[f][j])]
            nodes[k][2] = build(rows[less], depth - 1)
            nodes[k][3] = build(rows[~less], depth - 1)
            return k

        build(np.arange(len(g)), self.depth)
        cols = list(zip(*nodes, strict=True))
        return Tree(np.array(cols[0]), np.array(cols[1]), np.array(cols[2]), np.array(cols[3]), np.array(cols[4]))

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for t in self.trees:
            z += t.predict(x)
        return 1 / (1 + np.exp(-z))


@dataclass
class Isotonic:
    """Pool-adjacent-violators fit, between its points linear; the identity until fitted."""

    x: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    y: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))

    def fit(self, score: np.ndarray, truth: np.ndarray, prior: float = 0.5) -> Isotonic:
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []  # sum of truth, weight, first and last score
        for s, t in zip(score[order], truth[order], strict=True):
            blocks.append([float(t), 1.0, float(s), float(s)])
            while len(blocks) > 1 and (blocks[-2][0] + prior) * (blocks[-1][1] + 2 * prior) >= (blocks[-1][0] + prior) * (blocks[-2][1] + 2 * prior):
                t2, w2, _, b = blocks.pop()
                blocks[-1][0] += t2
                blocks[-1][1] += w2
                blocks[-1][3] = b
        xs, ys = [0.0], []
        for t, w, a, b in blocks:
            v = (t + prior) / (w + 2 * prior)
            xs += [a, b]
            ys += [v, v]
        self.x = np.maximum.accumulate(np.array([0.0, *xs[1:], 1.0]))
        self.y = np.maximum.accumulate(np.array([ys[0] if ys else 0.0, *ys, ys[-1] if ys else 1.0]))
        return self

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.x, self.y)
