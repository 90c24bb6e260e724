"""A generalised additive model with pairwise interactions, as lookup tables.

Features are cut into bins. Cyclic gradient boosting visits one feature after another and adds a shallow tree over its bins
to the feature's table; then the same over the pairs of features whose joint tables explain most of what is left. A
score is the sum of one table entry per feature and pair, so it can be read off and audited.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np

BINS, PAIR_BINS, PAIRS = 64, 12, 8
ROUNDS, PAIR_ROUNDS, RATE, RIDGE, LEAST_WEIGHT = 200, 80, 0.1, 1.0, 2.0


@dataclass
class AdditiveModel:
    intercept: float
    edges: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    pairs: list = field(default_factory=list)
    pair_edges: list = field(default_factory=list)
    pair_tables: list = field(default_factory=list)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Sums of table entries for rows of features."""
        total = np.full(len(x), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, j], "right")]
        coarse = [np.searchsorted(edges, x[:, j], "right") for j, edges in enumerate(self.pair_edges)]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[coarse[i], coarse[j]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -500, 500)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Cut points between neighbouring distinct values, at even shares of the rows."""
    distinct = np.unique(values)
    if len(distinct) < 2:
        return np.zeros(0)
    if len(distinct) > bins:
        at = np.unique(np.searchsorted(distinct, np.quantile(values, np.arange(1, bins) / bins, method="higher")))
        at = at[at > 0]
    else:
        at = np.arange(1, len(distinct))
    return (distinct[at - 1] + distinct[at]) / 2


def _gain(g, h):
    return g * g / (h + RIDGE)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The gain of the best cut of neighbouring bins in two, and its place; no gain without enough weight on both sides."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    total_g, total_h = g.sum(), h.sum()
    gains = _gain(left_g, left_h) + _gain(total_g - left_g, total_h - left_h) - _gain(total_g, total_h)
    gains[(left_h < LEAST_WEIGHT) | (total_h - left_h < LEAST_WEIGHT)] = 0
    at = int(np.argmax(gains)) if len(gains) else 0
    return (float(gains[at]), at + 1) if len(gains) else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """A tree of that depth over ordered bins, as one value per bin."""
    gain, at = _best_cut(g, h) if depth else (0.0, 0)
    if gain <= 0:
        return np.full(len(g), -g.sum() / (h.sum() + RIDGE))
    return np.concatenate([_tree(g[:at], h[:at], depth - 1), _tree(g[at:], h[at:], depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """One cut along one axis, then each side's best cut along the other: the gain and a value per cell."""
    best = (0.0, np.full(g.shape, -g.sum() / (h.sum() + RIDGE)))
    for axis in (0, 1):
        gg, hh = (g, h) if axis == 0 else (g.T, h.T)
        whole = _gain(g.sum(), h.sum())
        for at in range(1, len(gg)):
            gain, sides = -whole, []
            for part in (slice(0, at), slice(at, None)):
                a, b = gg[part].sum(0), hh[part].sum(0)
                gain += _gain(a.sum(), b.sum()) + _best_cut(a, b)[0]
                sides.append((part, a, b))
            if gain > best[0]:
                made = np.empty(gg.shape)
                for part, a, b in sides:
                    made[part] = _tree(a, b, 1)
                best = (gain, made if axis == 0 else made.T)
    return best


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS) -> AdditiveModel:
    """A model of labels 0 and 1 from rows of features. Without rows every score is 1, with one label only it is near that label."""
    if not len(y):
        return AdditiveModel(500.0)
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = AdditiveModel(float(np.log(share / (1 - share))))
    n = x.shape[1]
    model.edges = [_edges(x[:, j], BINS) for j in range(n)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    odds = np.full(len(y), model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-odds))
        return p - y, np.maximum(p * (1 - p), 1e-9)

    for _ in range(rounds):
        for b, table in zip(bins, model.tables):
            if len(table) > 1:
                g, h = slopes()
                step = RATE * _tree(np.bincount(b, g, len(table)), np.bincount(b, h, len(table)))
                table += step
                odds += step[b]
    model.pair_edges = [_edges(x[:, j], PAIR_BINS) for j in range(n)]
    sizes = [len(e) + 1 for e in model.pair_edges]
    coarse = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.pair_edges)]

    def joint(pair, values):
        i, j = pair
        return np.bincount(coarse[i] * sizes[j] + coarse[j], values, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])

    g, h = slopes()
    usable = [p for p in combinations(range(n), 2) if sizes[p[0]] > 1 and sizes[p[1]] > 1]
    ranked = sorted(usable, key=lambda p: -_pair_tree(joint(p, g), joint(p, h))[0])
    model.pairs = ranked[:pairs]
    model.pair_tables = [np.zeros((sizes[i], sizes[j])) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for pair, table in zip(model.pairs, model.pair_tables):
            g, h = slopes()
            step = RATE * _pair_tree(joint(pair, g), joint(pair, h))[1]
            table += step
            odds += step[coarse[pair[0]], coarse[pair[1]]]
    return model
