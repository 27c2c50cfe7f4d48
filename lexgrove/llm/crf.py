"""A linear-chain conditional random field with two labels, batched over sequences in numpy.

Sequences are flat: position features X (n, F) and lengths. All recursions run in
lock step over sequences sorted by length, so a batch costs as many numpy steps as its
longest sequence has lines.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

N_LABELS = 2


@dataclass
class Crf:
    """Emission weights (F, 2), transitions (2, 2) and start scores (2,); features are centred and scaled first."""

    emit: np.ndarray
    trans: np.ndarray
    start: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.emit


def layout(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of sequences by falling length, their first rows, how many are longer than t for each t)."""
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    first = (np.cumsum(lengths) - lengths)[order]
    longest = int(lengths[order[0]]) if len(order) else 0
    alive = np.searchsorted(-lengths[order], -np.arange(longest), side="left")
    return order, first, alive


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))


def viterbi(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The best label of every position; of equal paths the one with lower labels, from the end backwards."""
    out = np.zeros(len(scores), np.int8)
    order, first, alive = layout(lengths)
    if not len(order):
        return out
    back = np.zeros((len(scores), N_LABELS), np.int8)
    best = scores[first] + start
    for t in range(1, len(alive)):
        k = alive[t]
        rows = first[:k] + t
        step = best[:k, :, None] + trans[None]
        back[rows] = step.argmax(axis=1)
        best[:k] = step.max(axis=1) + scores[rows]
    label = best.argmax(axis=1)
    size = lengths[order]
    for t in range(len(alive) - 1, -1, -1):
        k = alive[t]
        rows = first[:k] + t
        inner = size[:k] > t + 1
        if inner.any():
            label[:k][inner] = back[rows[inner] + 1, label[:k][inner]]
        out[rows] = label[:k]
    return out


def marginals(
    scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray
) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward: P(label) by position, expected transition counts, sum of log partition functions."""
    order, first, alive = layout(lengths)
    n = len(scores)
    if not len(order):
        return np.zeros((n, N_LABELS)), np.zeros((N_LABELS, N_LABELS)), 0.0
    alpha, beta = np.zeros((n, N_LABELS)), np.zeros((n, N_LABELS))
    alpha[first] = scores[first] + start
    for t in range(1, len(alive)):
        rows = first[: alive[t]] + t
        alpha[rows] = _lse(alpha[rows - 1][:, :, None] + trans[None], 1) + scores[rows]
    for t in range(len(alive) - 2, -1, -1):
        rows = first[: alive[t + 1]] + t
        beta[rows] = _lse(trans[None] + (scores[rows + 1] + beta[rows + 1])[:, None, :], 2)
    log_z = _lse(alpha[first + lengths[order] - 1], 1)
    z = np.zeros(len(lengths))
    z[order] = log_z
    per_row = np.repeat(z, lengths)
    p = np.exp(alpha + beta - per_row[:, None])
    inner = np.ones(n, bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    pair = np.zeros((N_LABELS, N_LABELS))
    if len(at):
        joint = alpha[at - 1][:, :, None] + trans[None] + (scores[at] + beta[at])[:, None, :] - per_row[at][:, None, None]
        pair = np.exp(joint).sum(axis=0)
    return p, pair, float(log_z.sum())


def fit(x: np.ndarray, lengths: np.ndarray, y: np.ndarray, steps: int = 100, rate: float = 0.1, decay: float = 1e-3) -> Crf:
    """Maximum conditional likelihood by Adam; deterministic. Without rows all weights are 0."""
    width = x.shape[1]
    mean = x.mean(axis=0) if len(x) else np.zeros(width)
    scale = x.std(axis=0) if len(x) else np.ones(width)
    mean = np.where(scale > 1e-9, mean, 0.0)  # a constant column stays as a bias
    scale = np.where(scale > 1e-9, scale, 1.0)
    m = Crf(np.zeros((width, N_LABELS)), np.zeros((N_LABELS, N_LABELS)), np.zeros(N_LABELS), mean, scale)
    if not len(x):
        return m
    z = (x - mean) / scale
    first = (np.cumsum(lengths) - lengths)[lengths > 0]
    seen = np.zeros((len(y), N_LABELS))
    seen[np.arange(len(y)), y] = 1
    inner = np.ones(len(y), bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    pairs = np.zeros((N_LABELS, N_LABELS))
    np.add.at(pairs, (y[at - 1], y[at]), 1)
    par = [m.emit, m.trans, m.start]
    a, b = [np.zeros_like(w) for w in par], [np.zeros_like(w) for w in par]
    for step in range(1, steps + 1):
        p, pair, _ = marginals(z @ m.emit, lengths, m.trans, m.start)
        grads = [z.T @ (p - seen) / len(y), (pair - pairs) / len(y), (p[first] - seen[first]).sum(axis=0) / len(y)]
        for w, g, u, v in zip(par, grads, a, b, strict=True):
            g = g + decay * w
            u += 0.1 * (g - u)
            v += 0.001 * (g * g - v)
            w -= rate * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return m
