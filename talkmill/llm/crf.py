"""A linear-chain conditional random field over dense features: fitting by gradient, decoding by Viterbi."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class ChainCRF:
    emit: np.ndarray  # states x features
    move: np.ndarray  # states x states

    @classmethod
    def fit(cls, xs: list[np.ndarray], ys: list[np.ndarray], states: int = 2, passes: int = 80, step: float = 0.5, decay: float = 1e-3) -> ChainCRF:
        """Maximum likelihood over labelled sequences (units x features, units); without any, all weights are 0."""
        xs, ys = [x for x in xs if len(x)], [y for y in ys if len(y)]
        if not xs:
            raise ValueError("no labelled sequences")
        n, long, width = len(xs), max(map(len, xs)), xs[0].shape[1]
        x, y, on = np.zeros((n, long, width)), np.zeros((n, long), int), np.zeros((n, long))
        for i, (a, b) in enumerate(zip(xs, ys)):
            x[i, : len(a)], y[i, : len(a)], on[i, : len(a)] = a, b, 1
        emit, move = np.zeros((states, width)), np.zeros((states, states))
        g2e, g2m = np.full_like(emit, 1e-6), np.full_like(move, 1e-6)
        hot = np.eye(states)[y] * on[..., None]
        want_e = np.einsum("nts,ntf->sf", hot, x)
        want_m = np.einsum("nta,ntb->ab", hot[:, :-1], hot[:, 1:])
        both = on[:, 1:] * on[:, :-1]
        total = on.sum()
        for _ in range(passes):
            s = x @ emit.T
            alpha, beta = np.zeros_like(s), np.zeros_like(s)
            alpha[:, 0] = s[:, 0]
            for t in range(1, long):
                a = np.logaddexp.reduce(alpha[:, t - 1, :, None] + move, axis=1) + s[:, t]
                alpha[:, t] = np.where(on[:, t, None] > 0, a, alpha[:, t - 1])
            for t in range(long - 2, -1, -1):
                b = np.logaddexp.reduce(move + (s[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
                beta[:, t] = np.where(on[:, t + 1, None] > 0, b, 0)
            z = np.logaddexp.reduce(alpha[:, -1], axis=1)
            p = np.exp(alpha + beta - z[:, None, None]) * on[..., None]
            pair = np.exp(alpha[:, :-1, :, None] + move + (s[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[..., None, None]
            ge = (np.einsum("nts,ntf->sf", p, x) - want_e) / total + decay * emit
            gm = (pair.sum((0, 1)) - want_m) / total + decay * move
            g2e += ge * ge
            g2m += gm * gm
            emit -= step * ge / np.sqrt(g2e)
            move -= step * gm / np.sqrt(g2m)
        return cls(emit, move)

    def decode(self, x: np.ndarray) -> list[int]:
        """The likeliest states of one sequence; of equals the lower state."""
        if not len(x):
            return []
        scores, move = (x @ self.emit.T).tolist(), self.move.tolist()
        states = range(len(move))
        best, back = scores[0], []
        for s in scores[1:]:
            came = [max(states, key=lambda a, b=b: (best[a] + move[a][b], -a)) for b in states]
            best = [best[a] + move[a][b] + s[b] for b, a in enumerate(came)]
            back.append(came)
        at = max(states, key=lambda a: (best[a], -a))
        out = [at]
        for came in reversed(back):
            at = came[at]
            out.append(at)
        return out[::-1]
