"""A linear-chain conditional random field over small dense features, with Viterbi decoding.

States are outside, begin and inside. Chains are scored by emissions (features
times weights) and transitions; likelihood and gradient come from the forward
and backward recursions, in log space, over all chains of one length at once.
"""

from __future__ import annotations

import numpy as np

OUT, BEGIN, INSIDE = 0, 1, 2
STATES = 3
#: Inside cannot follow outside, nor begin a chain.
FORBIDDEN = -1e4


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


class CRF:
    def __init__(self, n_features: int):
        self.weights = np.zeros((n_features, STATES))
        self.trans = np.zeros((STATES, STATES))
        self.start = np.zeros(STATES)
        self.fixed = np.zeros((STATES, STATES))
        self.fixed[OUT, INSIDE] = FORBIDDEN
        self.fixed_start = np.array([0.0, 0.0, FORBIDDEN])

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Log likelihood and its gradient for chains x (chains, length, features) with states y."""
        chains, length, n = x.shape
        e = x @ self.weights
        t, s = self.trans + self.fixed, self.start + self.fixed_start
        a = np.zeros((length, chains, STATES))
        b = np.zeros((length, chains, STATES))
        a[0] = s + e[:, 0]
        for i in range(1, length):
            a[i] = _lse(a[i - 1][:, :, None] + t[None], 1) + e[:, i]
        for i in range(length - 2, -1, -1):
            b[i] = _lse(t[None] + (e[:, i + 1] + b[i + 1])[:, None, :], 2)
        z = _lse(a[-1], 1)
        p = np.exp(a + b - z[None, :, None]).transpose(1, 0, 2)
        real = np.eye(STATES)[y]
        grad_w = np.einsum("clf,cls->fs", x, real - p)
        grad_t = np.zeros((STATES, STATES))
        for i in range(1, length):
            joint = np.exp(a[i - 1][:, :, None] + t[None] + (e[:, i] + b[i])[:, None, :] - z[:, None, None])
            np.add.at(grad_t, (y[:, i - 1], y[:, i]), 1.0)
            grad_t -= joint.sum(axis=0)
        score = (s[y[:, 0]] + np.take_along_axis(e, y[:, :, None], 2)[:, :, 0].sum(axis=1)) + sum(t[y[:, i - 1], y[:, i]] for i in range(1, length))
        return float((score - z).sum()), grad_w, grad_t, (real[:, 0] - p[:, 0]).sum(axis=0)

    def fit(self, chains: list[tuple[np.ndarray, np.ndarray]], steps: int = 200, rate: float = 0.1, penalty: float = 0.02) -> CRF:
        """Adam on the mean log likelihood with a quadratic penalty; the same chains give the same weights."""
        by: dict[int, list] = {}
        for x, y in chains:
            by.setdefault(len(y), []).append((x, y))
        groups = [(np.stack([x for x, _ in g]), np.stack([y for _, y in g])) for _, g in sorted(by.items())]
        total = max(1, sum(len(y) for _, y in chains))
        params = [self.weights, self.trans, self.start]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            grads = [np.zeros_like(p) for p in params]
            for x, y in groups:
                for g, part in zip(grads, self._gradient(x, y)[1:], strict=True):
                    g += part
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                g = g / total - penalty * p / total
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def viterbi(self, e: np.ndarray) -> list[int]:
        """The best states of one chain, from the scores of its words (length, states): features times weights."""
        t = self.trans + self.fixed
        best, back = self.start + self.fixed_start + e[0], []
        for i in range(1, len(e)):
            through = best[:, None] + t
            back.append(through.argmax(axis=0))
            best = through.max(axis=0) + e[i]
        out = [int(best.argmax())]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]
