"""Sparse ordinal regression on hashed features, fitted on a bounded sample."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit(
    row: np.ndarray, feature: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int, dimension: int,
    pair: np.ndarray | None = None, pair_feature: np.ndarray | None = None, pair_value: np.ndarray | None = None,
    penalty: float = 0.0, l1: float = 3e-4, rate: float = 0.05, rounds: int = 120, least_rows: int = 5,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of P(grade <= k) = sigmoid(threshold_k - score).

    (row, feature, value) are the non-zero entries; ``pair`` entries are
    differences of two rows whose scores should agree: ``penalty`` times the
    mean square of their score is added to the loss. Adam steps with soft
    thresholding (l1); features of fewer than ``least_rows`` rows stay at 0.
    """
    n = max(1, len(grade))
    used = np.bincount(feature, minlength=dimension) >= least_rows
    if pair_feature is not None:
        used[pair_feature] = True
    number = np.cumsum(used) - 1
    keep = used[feature]
    row, feature, value = row[keep], number[feature[keep]], value[keep].astype(np.float64)
    m = int(used.sum())
    share = np.array([np.mean(grade > k) if len(grade) else 0.5 for k in range(grades - 1)]).clip(1 / (2 * n), 1 - 1 / (2 * n))
    theta = -np.log(share / (1 - share))
    params = np.concatenate([np.zeros(m), theta])
    mean, square = np.zeros_like(params), np.zeros_like(params)
    low_open, high_open = grade == 0, grade == grades - 1
    if pair is not None and len(pair):
        pair_feature, pairs = number[pair_feature], int(pair.max()) + 1
    for step in range(1, rounds + 1):
        w, theta = params[:m], params[m:]
        s = np.bincount(row, value * w[feature], minlength=n)[: len(grade)] if len(row) else np.zeros(len(grade))
        a = np.where(high_open, 1.0, sigmoid(theta[np.minimum(grade, grades - 2)] - s))
        b = np.where(low_open, 0.0, sigmoid(theta[np.maximum(grade - 1, 0)] - s))
        p = np.maximum(a - b, 1e-9)
        slope = 1 - a - b
        g = np.empty_like(params)
        g[:m] = np.bincount(feature, value * slope[row], minlength=m) / n
        up, down = a * (1 - a) / p, b * (1 - b) / p
        for k in range(grades - 1):
            g[m + k] = (down[grade == k + 1].sum() - up[grade == k].sum()) / n
        if pair is not None and len(pair):
            d = np.bincount(pair, pair_value * w[pair_feature], minlength=pairs)
            g[:m] += 2 * penalty * np.bincount(pair_feature, pair_value * d[pair], minlength=m) / pairs
        mean = 0.9 * mean + 0.1 * g
        square = 0.99 * square + 0.01 * g * g
        scale = rate / (np.sqrt(square / (1 - 0.99**step)) + 1e-4)
        params = params - scale * mean / (1 - 0.9**step)
        params[:m] = np.sign(params[:m]) * np.maximum(np.abs(params[:m]) - scale[:m] * l1, 0)
        params[m:] = np.sort(params[m:])
    weights = np.zeros(dimension, np.float32)
    weights[used] = params[:m]
    return weights, params[m:]
