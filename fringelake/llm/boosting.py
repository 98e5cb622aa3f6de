"""Gradient boosted trees over a counted table of small integer features.

The table has one row per distinct feature vector with the number of its positives and
negatives, so it's bounded by the product of the features' values, whatever was counted.
"""

from __future__ import annotations

import numpy as np


def _grow(x: np.ndarray, grad: np.ndarray, curve: np.ndarray, rows: np.ndarray, depth: int,
          ridge: float):
    g, h = grad[rows].sum(), curve[rows].sum()
    leaf = float(-g / (h + ridge))
    if depth == 0 or len(rows) < 2:
        return leaf
    best = (1e-9, None)
    for f in range(x.shape[1]):
        top = int(x[:, f].max()) + 1
        gs = np.bincount(x[rows, f], grad[rows], minlength=top).cumsum()[:-1]
        hs = np.bincount(x[rows, f], curve[rows], minlength=top).cumsum()[:-1]
        if len(gs):
            gain = gs ** 2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g * g / (h + ridge)
            gain[(hs < 1e-6) | (h - hs < 1e-6)] = 0
            cut = int(gain.argmax())
            if gain[cut] > best[0]:
                best = (float(gain[cut]), (f, cut))
    if best[1] is None:
        return leaf
    f, cut = best[1]
    left = x[rows, f] <= cut
    return (f, cut, _grow(x, grad, curve, rows[left], depth - 1, ridge),
            _grow(x, grad, curve, rows[~left], depth - 1, ridge))


def _apply(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, cut, left, right = tree
    return np.where(x[:, f] <= cut, _apply(left, x), _apply(right, x))


def number(x: float) -> str:
    """A double as a SQL literal."""
    return f"{float(x):.17e}D".replace("e", "E")


class Boosted:
    """Log-odds as a sum of trees (feature, cut, at most, above)."""

    def __init__(self, x: np.ndarray, pos: np.ndarray, neg: np.ndarray, *, trees: int = 24,
                 depth: int = 3, rate: float = 0.3, ridge: float = 1.0):
        self.base = float(np.log((pos.sum() + 1) / (neg.sum() + 1)))
        self.trees, odds = [], np.full(len(x), self.base)
        for _ in range(trees if len(x) else 0):
            p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            tree = _grow(x, (pos + neg) * p - pos, (pos + neg) * p * (1 - p), np.arange(len(x)),
                         depth, ridge)
            self.trees.append(self._scaled(tree, rate))
            odds += _apply(self.trees[-1], x)

    @classmethod
    def _scaled(cls, tree, rate):
        if not isinstance(tree, tuple):
            return rate * tree
        return (*tree[:2], cls._scaled(tree[2], rate), cls._scaled(tree[3], rate))

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((_apply(t, x) for t in self.trees), np.zeros(len(x)))

    def sql(self, names: list[str]) -> str:
        """The log-odds as a SQL expression over the features' names."""
        def expr(tree):
            if not isinstance(tree, tuple):
                return number(tree)
            f, cut, left, right = tree
            return f"CASE WHEN {names[f]} <= {cut} THEN {expr(left)} ELSE {expr(right)} END"

        return " + ".join([number(self.base), *map(expr, self.trees)])


def threshold(odds: np.ndarray, pos: np.ndarray, neg: np.ndarray, precision: float) -> float:
    """The least log-odds from which on the counted rows keep the precision, with one imagined negative;
    infinity if there's none."""
    order = np.argsort(-odds, kind="stable")
    good, bad = pos[order].cumsum(), neg[order].cumsum() + 1
    last = np.append(odds[order][1:] != odds[order][:-1], True) if len(odds) else odds > 0
    ok = np.flatnonzero((good >= precision * (good + bad)) & last)
    return float(odds[order][ok[-1]]) if len(ok) else float("inf")
