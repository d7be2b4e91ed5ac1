"""Small gradient-boosted trees on the driver, and the same trees as SQL expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Node:
    """A leaf has value; a split sends feature < at to the left."""

    value: float = 0.0
    feature: int = -1
    at: float = 0.0
    left: Node | None = None
    right: Node | None = None


@dataclass
class Boosted:
    bias: float
    trees: list[Node]
    threshold: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for t in self.trees:
            out += [leaf(t, r) for r in x]
        return out

    def column(self, features: list[Column]) -> Column:
        """The raw score over columns."""
        return sum((as_column(t, features) for t in self.trees), F.lit(self.bias))


    def sql(self, array: str) -> str:
        """The raw score as SQL over an array of features."""
        return " + ".join([f"{self.bias!r}D", *(as_sql(t, array) for t in self.trees)])


def as_sql(t: Node, array: str) -> str:
    if t.left is None:
        return f"({t.value!r}D)"
    return f"CASE WHEN {array}[{t.feature}] < {t.at!r}D THEN {as_sql(t.left, array)} ELSE {as_sql(t.right, array)} END"


def leaf(t: Node, row: np.ndarray) -> float:
    while t.left is not None:
        t = t.left if row[t.feature] < t.at else t.right
    return t.value


def as_column(t: Node, features: list[Column]) -> Column:
    if t.left is None:
        return F.lit(t.value)
    return F.when(features[t.feature] < F.lit(t.at), as_column(t.left, features)).otherwise(as_column(t.right, features))


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: int, rate: float) -> Node:
    """A tree of Newton steps; splits at midpoints, chosen by gain."""
    node = Node(value=float(rate * g.sum() / (h.sum() + 1.0)))
    if not depth or len(x) < 2 * least:
        return node
    best = 1e-6
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, gs, hs = x[order, j], np.cumsum(g[order]), np.cumsum(h[order])
        k = np.flatnonzero(v[1:] > v[:-1])
        k = k[(k + 1 >= least) & (len(x) - k - 1 >= least)]
        if not len(k):
            continue
        gain = gs[k] ** 2 / (hs[k] + 1) + (gs[-1] - gs[k]) ** 2 / (hs[-1] - hs[k] + 1) - gs[-1] ** 2 / (hs[-1] + 1)
        i = int(gain.argmax())
        if gain[i] > best:
            best, node.feature, node.at = float(gain[i]), j, float((v[k[i]] + v[k[i] + 1]) / 2)
    if node.feature >= 0:
        low = x[:, node.feature] < node.at
        node.left = grow(x[low], g[low], h[low], depth - 1, least, rate)
        node.right = grow(x[~low], g[~low], h[~low], depth - 1, least, rate)
    return node


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted scores and the non-decreasing probabilities that fit y best (pool adjacent violators)."""
    order = np.argsort(score, kind="stable")
    means: list[list[float]] = []
    for v in y[order].astype(float):
        means.append([v, 1])
        while len(means) > 1 and means[-2][0] >= means[-1][0]:
            (a, n), (b, m) = means[-2], means[-1]
            means[-2:] = [[(a * n + b * m) / (n + m), n + m]]
    return score[order], np.repeat([a for a, _ in means], [int(n) for _, n in means])


def boosted(x: np.ndarray, y: np.ndarray, test: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.3, least: int = 8, sure: float = 0.95) -> Boosted:
    """Fit on the rows not in test; the threshold is where the calibrated probability on test begins to be sure, even odds at least."""
    a, b = x[~test], y[~test]
    share = min(max(b.mean(), 1e-3), 1 - 1e-3)
    model = Boosted(float(np.log(share / (1 - share))), [])
    f = np.full(len(b), model.bias)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        t = grow(a, b - p, p * (1 - p), depth, least, rate)
        model.trees.append(t)
        f += [leaf(t, r) for r in a]
    score, prob = isotonic(model.raw(x[test]), y[test])
    good = np.flatnonzero(prob >= sure)
    # between the least score that is sure and the next below it, and no less than even odds
    model.threshold = max(0.0, float(score[good[0]] + score[max(0, good[0] - 1)]) / 2) if len(good) else float("inf")
    return model
