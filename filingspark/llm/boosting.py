"""Boosted trees of depth two on a table of small whole-number features with weights. The table is a histogram, so its size doesn't grow with the data."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def fit(x, positive, total, rounds: int = 24, rate: float = 0.3, least: float = 1.0):
    """x: (rows, features); of ``total`` cases in a row, ``positive`` are. Returns (base, trees); a tree is (feature, cut, left, right), inside as well, or a leaf's value."""
    import numpy as np

    if not len(x) or total.sum() == 0:
        return -10.0, []
    rate_of = np.clip(positive.sum() / total.sum(), 1e-4, 1 - 1e-4)
    base = float(np.log(rate_of / (1 - rate_of)))
    score = np.full(len(x), base)
    trees = []

    def grow(rows, g, h, depth):
        leaf = float(rate * g[rows].sum() / (h[rows].sum() + least))
        best = (1e-9, None)
        if depth:
            whole = g[rows].sum() ** 2 / (h[rows].sum() + least)
            for j in range(x.shape[1]):
                for c in np.unique(x[rows, j])[:-1]:
                    low = rows & (x[:, j] <= c)
                    high = rows & ~low
                    gain = g[low].sum() ** 2 / (h[low].sum() + least) + g[high].sum() ** 2 / (h[high].sum() + least) - whole
                    if gain > best[0]:
                        best = (gain, (j, int(c), low, high))
        if best[1] is None:
            return leaf
        j, c, low, high = best[1]
        return (j, c, grow(low, g, h, depth - 1), grow(high, g, h, depth - 1))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = grow(np.ones(len(x), bool), positive - total * p, total * p * (1 - p), 2)
        trees.append(tree)
        score = score + value(tree, x)
    return base, trees


def value(tree, x):
    import numpy as np

    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    j, c, left, right = tree
    return np.where(x[:, j] <= c, value(left, x), value(right, x))


def margins(model, x):
    base, trees = model
    return sum((value(t, x) for t in trees), base + 0.0 * x[:, 0]) if len(x) else []


def expression(model, features: list[Column]) -> Column:
    """The margin as a column."""

    def of(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(tree)
        j, c, left, right = tree
        return F.when(features[j] <= c, of(left)).otherwise(of(right))

    base, trees = model
    out = F.lit(base)
    for tree in trees:
        out = out + of(tree)
    return out


def threshold(margin, positive, total, share: float) -> float:
    """The lowest margin from which on the isotonic rate of positives (pool adjacent violators, one negative added to each pool) is at least ``share``; infinity if none is."""
    import numpy as np

    pools: list[list[float]] = []
    for i in np.argsort(margin, kind="stable"):
        if pools and pools[-1][0] == margin[i]:
            pools[-1][1] += positive[i]
            pools[-1][2] += total[i]
        else:
            pools.append([float(margin[i]), float(positive[i]), float(total[i])])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            m, p, n = pools.pop(-2)
            pools[-1] = [m, pools[-1][1] + p, pools[-1][2] + n]
    return next((m for m, p, n in pools if p / (n + 1) >= share), float("inf"))
