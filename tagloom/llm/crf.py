"""A linear-chain conditional random field with two labels."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Emission scores are held within this, so that a run of SCALE products stays in range.
LIMIT = 20.0
SCALE = 8


def _odds(emission: np.ndarray, starts: np.ndarray, step: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Forward odds of label 1 of every position of many chains laid end to end.

    emission: odds of each position.  starts: where a chain begins.
    step[a, b]: weight of b after a.  first: weights of the labels at a start.

    A position maps (forward weight of 0, of 1) by a 2 x 2 matrix, and a start
    forgets what was before.  The line is cut into about sqrt(n) blocks: the
    matrices of all blocks are multiplied side by side, the blocks' first
    values follow in turn, and the odds inside all blocks side by side again.
    """
    n = len(emission)
    if n == 0:
        return np.empty(0)
    length = max(1, int(np.sqrt(n)))
    blocks = -(-n // length)

    def laid(x: np.ndarray, fill: float) -> np.ndarray:
        return np.ascontiguousarray(np.concatenate([x, np.full(blocks * length - n, fill)]).reshape(blocks, length).T)

    e, s = laid(emission, 1.0), laid(starts, 1.0).astype(bool)
    w00, w10 = np.where(s, first[0], step[0, 0]), np.where(s, first[0], step[1, 0])
    w01, w11 = np.where(s, first[1], step[0, 1]) * e, np.where(s, first[1], step[1, 1]) * e
    x0, x1, y0, y1 = np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)
    for j in range(length):
        x0, x1 = w00[j] * x0 + w10[j] * x1, w01[j] * x0 + w11[j] * x1
        y0, y1 = w00[j] * y0 + w10[j] * y1, w01[j] * y0 + w11[j] * y1
        if j % SCALE == SCALE - 1:
            top = np.maximum(np.maximum(x0, x1), np.maximum(y0, y1))
            x0, x1, y0, y1 = x0 / top, x1 / top, y0 / top, y1 / top
    before = np.empty(blocks)
    r = 1.0
    for b in range(blocks):
        before[b] = r
        r = (x1[b] + y1[b] * r) / (x0[b] + y0[b] * r)
        r = min(max(r, 1e-200), 1e200)
    out = np.empty((length, blocks))
    r = before
    for j in range(length):
        out[j] = r = (w01[j] + w11[j] * r) / (w00[j] + w10[j] * r)
    return out.T.reshape(-1)[:n]


def marginals(emission: np.ndarray, starts: np.ndarray, step: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probability of label 1, forward odds, backward odds with the position's own emission) of every position."""
    e = np.exp(np.clip(emission, -LIMIT, LIMIT))
    forward = _odds(e, starts, step, first)
    ends = np.roll(starts, -1)
    if len(ends):
        ends[-1] = 1
    backward = _odds(e[::-1], ends[::-1], step.T, np.ones(2))[::-1]
    odds = forward * (backward / e)
    return odds / (1 + odds), forward, backward


@dataclass
class Chain:
    """Transition weights (log) of the labels; the emission is the caller's."""

    transition: np.ndarray = field(default_factory=lambda: np.array([[0.0, -2.0], [-2.0, 0.0]]))
    first: float = 0.0

    def marginals(self, emission: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return marginals(emission, starts, np.exp(self.transition), np.exp([0.0, self.first]))[0]

    def gradient(self, emission: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Gradients of the log-likelihood by emission, transition and first."""
        step, first = np.exp(self.transition), np.exp([0.0, self.first])
        p, forward, backward = marginals(emission, starts, step, first)
        inner = np.flatnonzero(starts[1:] == 0)
        a, b = forward[inner], backward[inner + 1]
        pair = np.stack([np.full(len(inner), step[0, 0]), step[0, 1] * b, step[1, 0] * a, step[1, 1] * a * b])
        pair /= pair.sum(0)
        y = labels.astype(int)
        seen = np.bincount(2 * y[inner] + y[inner + 1], minlength=4)
        at = starts.astype(bool)
        return labels - p, (seen - pair.sum(1)).reshape(2, 2), float((labels - p)[at].sum())


class Adam:
    """Gradient ascent with moments."""

    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def tick(self) -> None:
        self.t += 1

    def step(self, name: str, value: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        m = self.m[name] = 0.9 * self.m.get(name, 0) + 0.1 * gradient
        v = self.v[name] = 0.99 * self.v.get(name, 0) + 0.01 * gradient**2
        return value + self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)


def calibrate(features: np.ndarray, labels: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the intercept."""
    x = np.hstack([features, np.ones((len(features), 1))])
    w = np.zeros(x.shape[1])
    if len(features) == 0:
        return w
    penalty = ridge * len(x) * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty
        d = np.linalg.solve(h, x.T @ (labels - p) - penalty @ w)
        w += d
        if np.abs(d).max() < 1e-8:
            break
    return w


def logistic(features: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features @ w[:-1] + w[-1], -30, 30)))
