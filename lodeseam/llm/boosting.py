"""Gradient-boosted trees of depth two on small feature tables, trained on the driver, scored as column expressions."""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column
from pyspark.sql import functions as F

Tree = tuple  # (feature, cut, left, right); leaves are numbers


def _best(rows: list[list[float]], g: list[float], h: list[float], members: list[int], cuts: list[list[float]]) -> tuple | None:
    total_g, total_h = sum(g[i] for i in members), sum(h[i] for i in members)
    best = None
    for f, options in enumerate(cuts):
        for c in options:
            lg = lh = 0.0
            for i in members:
                if rows[i][f] < c:
                    lg += g[i]
                    lh += h[i]
            if lh < 1 or total_h - lh < 1:
                continue
            gain = lg * lg / (lh + 1) + (total_g - lg) ** 2 / (total_h - lh + 1)
            if best is None or gain > best[0] + 1e-9:
                best = gain, f, c
    return best


def _leaf(g: list[float], h: list[float], members: list[int], rate: float) -> float:
    return rate * sum(g[i] for i in members) / (sum(h[i] for i in members) + 1)


def _grow(rows, g, h, members, cuts, depth: int, rate: float):
    best = _best(rows, g, h, members, cuts) if depth else None
    if not best:
        return _leaf(g, h, members, rate)
    _, f, c = best
    left, right = [i for i in members if rows[i][f] < c], [i for i in members if rows[i][f] >= c]
    return f, c, _grow(rows, g, h, left, cuts, depth - 1, rate), _grow(rows, g, h, right, cuts, depth - 1, rate)


def value(tree, row: list[float]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] < tree[1] else tree[3]
    return tree


class BoostedTrees:
    """Log loss, Newton leaves; cuts are between the values that occur, eight a feature at most."""

    def __init__(self, rounds: int = 25, depth: int = 2, rate: float = 0.5) -> None:
        self.rounds, self.depth, self.rate, self.bias, self.trees = rounds, depth, rate, 0.0, []

    def fit(self, rows: list[list[float]], labels: list[bool]) -> BoostedTrees:
        cuts = []
        for f in range(len(rows[0])):
            seen = sorted({r[f] for r in rows})
            cuts.append([(a + b) / 2 for a, b in zip(seen, seen[1:], strict=False)][:: max(1, (len(seen) - 1) // 8)])
        share = (sum(labels) + 1) / (len(labels) + 2)
        self.bias = log(share / (1 - share))
        score = [self.bias] * len(rows)
        for _ in range(self.rounds):
            p = [1 / (1 + exp(-s)) for s in score]
            tree = _grow(rows, [y - q for y, q in zip(labels, p, strict=True)], [q * (1 - q) for q in p], list(range(len(rows))), cuts, self.depth, self.rate)
            self.trees.append(tree)
            score = [s + value(tree, r) for s, r in zip(score, rows, strict=True)]
        return self

    def score(self, row: list[float]) -> float:
        return self.bias + sum(value(t, row) for t in self.trees)

    def column(self, features: list[Column]) -> Column:
        def said(tree) -> Column:
            return F.when(features[tree[0]] < tree[1], said(tree[2])).otherwise(said(tree[3])) if isinstance(tree, tuple) else F.lit(float(tree))

        out = F.lit(float(self.bias))
        for t in self.trees:
            out = out + said(t)
        return out


def calibrated(scores: list[float], labels: list[bool], precision: float) -> float:
    """The lowest score, but none under even odds, from which on the share of true ones is at least `precision` (half a false
    one is assumed beforehand). Equal scores stand or fall together."""
    best, good, n = float("inf"), 0, 0
    pairs = sorted(zip(scores, labels, strict=True), reverse=True)
    for k, (s, y) in enumerate(pairs):
        good, n = good + y, n + 1
        if (k + 1 == len(pairs) or pairs[k + 1][0] < s) and s >= 0 and good / (n + 0.5) >= precision:
            best = s
    return best
