"""Logistic regression on bounded samples, for the classifiers of this package."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1.0, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Weights and intercept by Newton steps; ``y`` may hold shares between 0 and 1.

    Without rows, or with one class alone, the weights are 0 and the intercept says the share.
    """
    n, d = x.shape
    weight = np.ones(n) if weight is None else weight
    total = weight.sum()
    share = float((weight * y).sum() / total) if total else 0.0
    base = float(np.log((share * total + 0.5) / ((1 - share) * total + 0.5)))
    if not total or share in (0.0, 1.0):
        return np.zeros(d), base
    design = np.hstack([x, np.ones((n, 1))])
    beta = np.r_[np.zeros(d), base]
    penalty = np.r_[np.full(d, l2), 1e-6]
    for _ in range(rounds):
        p = sigmoid(design @ beta)
        slope = design.T @ (weight * (y - p)) - penalty * beta
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return beta[:-1], float(beta[-1])


def ranked_above(score: np.ndarray, y: np.ndarray) -> float:
    """Chance that a row of class 1 scores above one of class 0 (area under the curve)."""
    order = np.argsort(score, kind="stable")
    _, where, counts = np.unique(score[order], return_inverse=True, return_counts=True)
    rank = np.empty(len(score))
    rank[order] = (np.cumsum(counts) - (counts - 1) / 2)[where]
    ones = y == 1
    return float((rank[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum()))
