"""Binary linear-chain conditional random fields over flat arrays of many sequences.

Sequences lie end to end; ``starts`` marks their first positions. With two states the forward and backward messages
are ratios that follow a Moebius recursion, which is scanned in columns: each column's map is composed first, then the
columns are chained, then all values follow. So one long sequence costs no more than many short ones.
"""

from __future__ import annotations

import numpy as np


def _scan(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """r[t] = (a r[t-1] + b) / (c r[t-1] + d); the first step must not depend on r[-1] (a = c = 0 there)."""
    n = len(a)
    if not n:
        return np.zeros(0)
    columns = max(1, min(512, int(np.sqrt(n))))
    length = -(-n // columns)
    pad = columns * length - n

    def shaped(x, fill):
        return np.ascontiguousarray(np.concatenate((x, np.full(pad, fill))).reshape(columns, length).T)

    a, b, c, d = shaped(a, 1.0), shaped(b, 0.0), shaped(c, 0.0), shaped(d, 1.0)
    ma, mb, mc, md = np.ones(columns), np.zeros(columns), np.zeros(columns), np.ones(columns)
    for t in range(length):
        at, bt, ct, dt = a[t], b[t], c[t], d[t]
        ma, mb, mc, md = at * ma + bt * mc, at * mb + bt * md, ct * ma + dt * mc, ct * mb + dt * md
        if t % 4 == 3:
            scale = 1 / np.maximum(np.maximum(ma, mb), np.maximum(mc, md))
            ma, mb, mc, md = ma * scale, mb * scale, mc * scale, md * scale
    r = np.ones(columns)
    for k in range(1, columns):
        x = r[k - 1]
        r[k] = (ma[k - 1] * x + mb[k - 1]) / (mc[k - 1] * x + md[k - 1])
    out = np.empty((length, columns))
    for t in range(length):
        r = (a[t] * r + b[t]) / (c[t] * r + d[t])
        out[t] = r
    return out.T.reshape(-1)[:n]


def messages(logit: np.ndarray, starts: np.ndarray, trans: np.ndarray, init: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """exp(logit), and the forward and backward ratios of state 1 to state 0."""
    n = len(logit)
    e = np.exp(np.clip(logit, -25, 25))
    t = np.exp(trans)
    first = np.zeros(n, bool)
    first[starts] = True
    last = np.roll(first, -1)
    r = _scan(np.where(first, 0, e * t[1, 1]), np.where(first, e * np.exp(init), e * t[0, 1]), np.where(first, 0, t[1, 0]), np.where(first, 1, t[0, 0]))
    after = np.roll(e, -1)
    s = _scan(np.where(last, 0, t[1, 1] * after)[::-1], np.where(last, 1, t[1, 0])[::-1], np.where(last, 0, t[0, 1] * after)[::-1], np.where(last, 1, t[0, 0])[::-1])[::-1]
    return e, r, s


def marginals(logit: np.ndarray, starts: np.ndarray, trans: np.ndarray, init: float) -> np.ndarray:
    """P(state 1) at every position, by forward-backward. ``starts`` must be ascending and begin with 0."""
    if not len(logit):
        return np.zeros(0)
    _, r, s = messages(logit, starts, trans, init)
    odds = r * s
    return odds / (1 + odds)


def gradients(logit: np.ndarray, starts: np.ndarray, y: np.ndarray, trans: np.ndarray, init: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Of the log-likelihood of labels ``y``: for each logit, for the transitions, for the initial weight."""
    e, r, s = messages(logit, starts, trans, init)
    odds = r * s
    p = odds / (1 + odds)
    inner = np.ones(len(logit), bool)
    inner[starts] = False
    t = np.flatnonzero(inner)
    w = np.exp(trans)
    before, now = r[t - 1], e[t] * s[t]
    cells = np.stack((np.full(len(t), w[0, 0]), w[0, 1] * now, before * w[1, 0], before * w[1, 1] * now))
    expected = (cells / cells.sum(0)).sum(1).reshape(2, 2)
    observed = np.bincount(2 * y[t - 1] + y[t], minlength=4).reshape(2, 2)
    return y - p, observed - expected, float((y[starts] - p[starts]).sum())


class Adam:
    """Ascends a gradient held in named arrays."""

    def __init__(self, rate: float = 0.1):
        self.rate, self.step, self.m, self.v = rate, 0, {}, {}

    def update(self, params: dict, grads: dict) -> None:
        self.step += 1
        for k, g in grads.items():
            m = self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * g
            v = self.v[k] = 0.99 * self.v.get(k, 0) + 0.01 * g * g
            params[k] = params[k] + self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.99**self.step)) + 1e-8)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights of a logistic regression by Newton steps; the last column of ``x`` should be 1."""
    w = np.zeros(x.shape[1])
    weight = np.ones(len(y)) if weight is None else weight
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (y - p)) - l2 * len(y) * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + (l2 * len(y) + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w + step / max(1.0, np.abs(step).max() / 3)
        if np.abs(step).max() < 1e-6:
            break
    return w
