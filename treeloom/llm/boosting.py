"""Gradient-boosted depth-2 trees over binary features, from counts of feature patterns.

When every feature is a bit, the loss depends only on how many positive and negative rows
show each pattern, so one distributed aggregation (at most 2^bits rows) replaces the rows
themselves and boosting is exact over the whole corpus. A fitted model turns into a SQL
expression over the pattern, so scoring stays in the JVM.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class Model:
    """bias plus trees (feature a, feature b, leaf values for the bits 00, 01, 10, 11)."""

    def __init__(self, bias: float, trees: list[tuple[int, int, tuple[float, float, float, float]]]):
        self.bias, self.trees = bias, trees

    def margins(self, masks: np.ndarray) -> np.ndarray:
        out = np.full(len(masks), self.bias)
        for a, b, leaves in self.trees:
            out += np.array(leaves)[2 * (masks >> a & 1) + (masks >> b & 1)]
        return out

    def expression(self, mask: Column) -> Column:
        """The margin of a pattern column."""
        bit = lambda i: F.shiftright(mask, i).bitwiseAND(F.lit(1).cast("long"))
        total = F.lit(float(self.bias))
        for a, b, leaves in self.trees:
            at = (2 * bit(a) + bit(b) + 1).cast("int")
            total = total + F.element_at(F.array(*[F.lit(float(v)) for v in leaves]), at)
        return total


def fit(masks: np.ndarray, positive: np.ndarray, negative: np.ndarray, bits: int, rounds: int = 24, rate: float = 0.4, ridge: float = 1.0) -> Model:
    """Newton boosting on the logistic loss; each round takes the best pair of features."""
    if not len(masks) or not positive.sum() or not negative.sum():
        return Model(-10.0 if not positive.sum() else 10.0, [])
    count = positive + negative
    bias = float(np.log(positive.sum() / negative.sum()))
    trees = []
    margin = np.full(len(masks), bias)
    cells = {(a, b): 2 * (masks >> a & 1) + (masks >> b & 1) for a, b in itertools.combinations(range(bits), 2)}
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = positive - count * p, count * p * (1 - p)
        best = None
        for pair, cell in cells.items():
            g, h = np.bincount(cell, gradient, 4), np.bincount(cell, weight, 4)
            gain = float((g * g / (h + ridge)).sum())
            if best is None or gain > best[0]:
                best = gain, pair, rate * g / (h + ridge), cell
        trees.append((*best[1], tuple(float(v) for v in best[2])))
        margin = margin + best[2][best[3]]
    return Model(bias, trees)


def threshold(margins: np.ndarray, positive: np.ndarray, negative: np.ndarray, precision: float) -> float:
    """The lowest margin from which held-out candidates reach the precision; infinite if none does."""
    order = np.argsort(-margins, kind="stable")
    hits, misses = np.cumsum(positive[order]), np.cumsum(negative[order])
    last = np.append(margins[order][1:] != margins[order][:-1], True) if len(order) else np.zeros(0, bool)
    good = last & (hits >= precision * (hits + misses)) & (hits > 0)
    return float(margins[order][np.flatnonzero(good)[-1]]) if good.any() else float("inf")
