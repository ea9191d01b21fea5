"""A small linear support vector machine: squared hinge loss, solved by Newton steps."""

from __future__ import annotations

import numpy as np


def fit(x: np.ndarray, y: np.ndarray, cost: float = 1.0, weight: np.ndarray | None = None, steps: int = 30, block: int = 8192, pick: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """(w, b) for labels +1 and -1; the loss of row i counts weight[i] times.

    Rows are widened to double precision a block at a time, so x may be single. With
    pick, row i is x[pick[i]].
    """
    pick = np.arange(len(x)) if pick is None else pick
    n, d = len(pick), x.shape[1]
    weight = np.ones(n) if weight is None else weight
    ridge = np.append(np.ones(d), 1e-6)
    w = np.zeros(d + 1)

    def margins(w: np.ndarray) -> np.ndarray:
        return np.concatenate([x[pick[low : low + block]].astype(float) @ w[:-1] + w[-1] for low in range(0, n, block)])

    def loss(gap: np.ndarray, w: np.ndarray) -> float:
        gap = np.maximum(0, gap)
        return 0.5 * float(ridge @ (w * w)) + 0.5 * cost * float(weight @ (gap * gap))

    gap = 1 - y * margins(w)
    now = loss(gap, w)
    for _ in range(steps):
        grad, hess = ridge * w, np.diag(ridge)
        on = np.flatnonzero(gap > 0)
        for low in range(0, len(on), block):
            at = on[low : low + block]
            z = np.hstack((x[pick[at]].astype(float), np.ones((len(at), 1))))
            c = cost * weight[at]
            grad = grad - z.T @ (c * y[at] * gap[at])
            hess = hess + (z * c[:, None]).T @ z
        move, size = np.linalg.solve(hess, grad), 1.0
        while True:
            new = w - size * move
            new_gap = 1 - y * margins(new)
            new_loss = loss(new_gap, new)
            if new_loss <= now or size < 1e-4:
                break
            size /= 2
        done = now - new_loss <= 1e-6 * now
        w, gap, now = new, new_gap, new_loss
        if done:
            break
    return w[:-1], float(w[-1])


def platt(margin: np.ndarray, y: np.ndarray, caution: float = 1.0, steps: int = 50) -> tuple[float, float]:
    """(a, b) of the logistic 1 / (1 + exp(-(a * margin + b))) for labels 0 and 1, with a > 0.

    The classes weigh alike, label 0 `caution` times as much.
    """
    pos, neg = max(1.0, float((y == 1).sum())), max(1.0, float((y == 0).sum()))
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    weight = np.where(y == 1, 0.5 / pos, 0.5 * caution / neg) * (pos + neg)
    scale = max(float(np.std(margin)), 1e-9)
    z = np.stack((margin / scale, np.ones(len(margin))), 1)
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (weight * (p - target)) + 1e-6 * w
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-4 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hess, grad), -5, 5)
    return max(float(w[0]), 1e-3) / scale, float(w[1])


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
