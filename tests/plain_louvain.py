"""Local moves node by node, in one process: what the table rounds are held against."""

import numpy as np


def louvain(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, gamma: float, seed: int, refine: bool = True, rounds: int = 20) -> np.ndarray:
    """Labels of ``n`` nodes by local moves and aggregation, refined inside communities; labels by size, then least node.

    Weights are those of ``modularity``: each unordered pair has twice its weight, a loop once.
    """
    keep = src < dst
    pairs = (np.concatenate((src[keep], src[src == dst])), np.concatenate((dst[keep], dst[src == dst])), np.concatenate((2 * w[keep], w[src == dst])))
    member = np.arange(n)
    draw = np.random.default_rng(seed)
    i, j, x = pairs
    size = n
    start = None
    for _ in range(rounds):
        label = _moves(size, i, j, x, gamma, draw, start)
        _, label = np.unique(label, return_inverse=True)
        if label.max(initial=-1) + 1 == size:
            break
        part = label
        if refine:
            inner = label[i] == label[j]
            part = _moves(size, i[inner], j[inner], x[inner], gamma, draw, None, within=label, strengths=_strength(size, i, j, x))
            _, part = np.unique(part, return_inverse=True)
            if part.max(initial=-1) + 1 == size:
                part = label
        start = np.zeros(part.max() + 1, np.int64)
        start[part] = label
        member = part[member]
        size = len(start)
        a, b = np.minimum(part[i], part[j]), np.maximum(part[i], part[j])
        key, at = np.unique(a * size + b, return_inverse=True)
        i, j, x = key // size, key % size, np.bincount(at, x)
        last = label if part is label else None
        if last is not None:
            start = None
    label = member if start is None else start[member]
    order = sorted(np.unique(label), key=lambda c: (-(label == c).sum(), np.flatnonzero(label == c)[0]))
    rank = {c: k for k, c in enumerate(order)}
    return np.array([rank[c] for c in label], np.int64)


def _strength(n, i, j, x):
    return np.bincount(i, x, n) + np.bincount(j, x, n)


def _moves(n, i, j, x, gamma, draw, start=None, within=None, strengths=None):
    """Greedy moves of single nodes until none gains; ``within`` keeps nodes inside their community."""
    m = x.sum() if strengths is None else strengths.sum() / 2
    k = _strength(n, i, j, x) if strengths is None else strengths
    off = i != j
    a, b, v = np.concatenate((i[off], j[off])), np.concatenate((j[off], i[off])), np.concatenate((x[off], x[off]))
    order = np.argsort(a, kind="stable")
    a, b, v = a[order], b[order], v[order]
    at = np.searchsorted(a, np.arange(n + 1))
    label = np.arange(n) if start is None else start.copy()
    total = np.bincount(label, k, n)
    if m <= 0:
        return label
    moved = True
    for _ in range(50):
        if not moved:
            break
        moved = False
        for node in draw.permutation(n):
            near, weight = b[at[node] : at[node + 1]], v[at[node] : at[node + 1]]
            if not len(near):
                continue
            own = label[node]
            total[own] -= k[node]
            options, where = np.unique(label[near], return_inverse=True)
            gain = np.bincount(where, weight) - gamma * k[node] * total[options] / (2 * m)
            stay = weight[label[near] == own].sum() - gamma * k[node] * total[own] / (2 * m)
            best = int(np.argmax(gain))
            if gain[best] > stay + 1e-12:
                label[node] = options[best]
                moved = True
            total[label[node]] += k[node]
    return label
