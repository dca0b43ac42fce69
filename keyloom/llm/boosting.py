"""Gradient boosting of small regression trees in numpy, and the trees as SQL."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Leaf:
    value: float

    def sql(self, names: list[str]) -> str:
        return f"{self.value:.6f}D"


@dataclass(frozen=True)
class Split:
    feature: int
    at: float
    low: "Leaf | Split"
    high: "Leaf | Split"

    def sql(self, names: list[str]) -> str:
        return f"CASE WHEN {names[self.feature]} <= {self.at:.6f}D THEN {self.low.sql(names)} ELSE {self.high.sql(names)} END"


def _predict(tree: Leaf | Split, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, Leaf):
        return np.full(len(x), tree.value)
    return np.where(x[:, tree.feature] <= tree.at, _predict(tree.low, x), _predict(tree.high, x))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, ridge: float) -> Leaf | Split:
    """Newton step on gradients ``g`` and curvatures ``h``; the split with the largest gain."""
    value = Leaf(float(-g.sum() / (h.sum() + ridge)))
    if depth == 0 or len(x) < 8:
        return value
    best, found = g.sum() ** 2 / (h.sum() + ridge) + 1e-6, None
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, sg, sh = x[order, j], np.cumsum(g[order]), np.cumsum(h[order])
        cuts = np.nonzero(v[1:] > v[:-1])[0]
        if not len(cuts):
            continue
        gain = sg[cuts] ** 2 / (sh[cuts] + ridge) + (sg[-1] - sg[cuts]) ** 2 / (sh[-1] - sh[cuts] + ridge)
        i = int(gain.argmax())
        if gain[i] > best:
            best, found = gain[i], (j, float((v[cuts[i]] + v[cuts[i] + 1]) / 2))
    if not found:
        return value
    j, at = found
    low = x[:, j] <= at
    return Split(j, at, _grow(x[low], g[low], h[low], depth - 1, ridge), _grow(x[~low], g[~low], h[~low], depth - 1, ridge))


@dataclass
class Boosted:
    bias: float
    trees: list

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum((_predict(t, x) for t in self.trees), np.zeros(len(x)))

    def sql(self, names: list[str]) -> str:
        """The logit as one SQL expression over columns or fields ``names``."""
        return " + ".join([f"{self.bias:.6f}D", *(f"({t.sql(names)})" for t in self.trees)])


def boost(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3, ridge: float = 1.0) -> Boosted:
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Boosted(float(np.log(p / (1 - p))), [])
    z = np.full(len(y), model.bias)

    def shrunk(t: Leaf | Split) -> Leaf | Split:
        return Leaf(t.value * rate) if isinstance(t, Leaf) else Split(t.feature, t.at, shrunk(t.low), shrunk(t.high))

    for _ in range(trees):
        q = 1 / (1 + np.exp(-z))
        tree = shrunk(_grow(x, q - y, q * (1 - q), depth, ridge))
        model.trees.append(tree)
        z += _predict(tree, x)
    return model
