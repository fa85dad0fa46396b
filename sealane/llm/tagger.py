"""A character-level bidirectional LSTM with a CRF over tags, in numpy."""

from __future__ import annotations

import numpy as np

from sealane.llm.spans import N_CODES, Adam


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    """Tags 0 (outside), then begin and inside of each kind.

    Transitions are learned, except that an inside tag can only follow its own kind.
    """

    def __init__(self, n_kinds: int, hidden: int = 16, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.n_tags, self.hidden = 1 + 2 * n_kinds, hidden
        self.weights = {"trans": np.zeros((self.n_tags, self.n_tags)), "out": rng.normal(0, 0.2, (2 * hidden, self.n_tags)), "bias": np.zeros(self.n_tags)}
        for side in "fb":
            self.weights |= {f"x{side}": rng.normal(0, 0.2, (N_CODES, 4 * hidden)), f"h{side}": rng.normal(0, 0.2, (hidden, 4 * hidden)), f"c{side}": np.repeat([0.0, 1.0, 0.0, 0.0], hidden)}
        self.illegal = np.zeros((self.n_tags, self.n_tags))
        for tag in range(2, self.n_tags, 2):
            self.illegal[:, tag] = -1e4
            self.illegal[[tag - 1, tag], tag] = 0
        self.illegal_first = np.where((np.arange(self.n_tags) % 2 == 0) & (np.arange(self.n_tags) > 0), -1e4, 0.0)

    def _lstm(self, x: np.ndarray, side: str):
        """Hidden states over time (T, B, H) and what the backward pass needs."""
        w, size = self.weights, self.hidden
        h, c, states = np.zeros((x.shape[0], size)), np.zeros((x.shape[0], size)), []
        for t in range(x.shape[1]):
            z = w[f"x{side}"][x[:, t]] + h @ w[f"h{side}"] + w[f"c{side}"]
            i, f, o = _sigmoid(z[:, :size]), _sigmoid(z[:, size : 2 * size]), _sigmoid(z[:, 2 * size : 3 * size])
            g = np.tanh(z[:, 3 * size :])
            before, c = c, f * c + i * g
            tanh_c = np.tanh(c)
            states.append((i, f, o, g, before, tanh_c, h))
            h = o * tanh_c
        return np.stack([s[2] * s[5] for s in states]), states

    def _lstm_back(self, x: np.ndarray, states: list, dh_all: np.ndarray, side: str) -> dict[str, np.ndarray]:
        w, size = self.weights, self.hidden
        out = {k: np.zeros_like(w[k]) for k in (f"x{side}", f"h{side}", f"c{side}")}
        dh, dc = np.zeros_like(dh_all[0]), np.zeros_like(dh_all[0])
        for t in reversed(range(len(states))):
            i, f, o, g, before, tanh_c, h_before = states[t]
            dh = dh + dh_all[t]
            dc = dc + dh * o * (1 - tanh_c**2)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tanh_c * o * (1 - o), dc * i * (1 - g**2)], 1)
            np.add.at(out[f"x{side}"], x[:, t], dz)
            out[f"h{side}"] += h_before.T @ dz
            out[f"c{side}"] += dz.sum(0)
            dh, dc = dz @ w[f"h{side}"].T, dc * f
        return out

    def _emissions(self, x: np.ndarray):
        forward, keep_f = self._lstm(x, "f")
        backward, keep_b = self._lstm(x[:, ::-1], "b")
        both = np.concatenate([forward, backward[::-1]], 2)
        return both @ self.weights["out"] + self.weights["bias"], both, keep_f, keep_b

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of tag paths ``y`` and its gradients."""
        w, trans = self.weights, self.weights["trans"] + self.illegal
        emit, both, keep_f, keep_b = self._emissions(x)
        length, n = emit.shape[:2]
        alpha, beta = np.empty_like(emit), np.zeros_like(emit)
        alpha[0] = emit[0] + self.illegal_first
        for t in range(1, length):
            alpha[t] = np.logaddexp.reduce(alpha[t - 1][:, :, None] + trans, 1) + emit[t]
        for t in range(length - 2, -1, -1):
            beta[t] = np.logaddexp.reduce(trans + (emit[t + 1] + beta[t + 1])[:, None, :], 2)
        norm = np.logaddexp.reduce(alpha[-1], 1)
        demit = np.exp(alpha + beta - norm[None, :, None])
        dtrans, gold = np.zeros_like(trans), np.zeros(n)
        rows = np.arange(n)
        for t in range(length):
            demit[t, rows, y[:, t]] -= 1
            gold += emit[t, rows, y[:, t]]
            if t:
                dtrans += np.exp(alpha[t - 1][:, :, None] + trans + (emit[t] + beta[t])[:, None, :] - norm[:, None, None]).sum(0)
                np.add.at(dtrans, (y[:, t - 1], y[:, t]), -1)
                gold += trans[y[:, t - 1], y[:, t]]
        demit /= n
        out = {"trans": dtrans / n, "out": np.einsum("tbh,tbk->hk", both, demit), "bias": demit.sum((0, 1))}
        dboth = demit @ w["out"].T
        out |= self._lstm_back(x, keep_f, dboth[:, :, : self.hidden], "f")
        out |= self._lstm_back(x[:, ::-1], keep_b, dboth[::-1, :, self.hidden :], "b")
        return float((norm - gold).mean()), out

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int = 64, rate: float = 0.02, seed: int = 5) -> list[float]:
        rng, adam, losses = np.random.default_rng(seed), Adam(self.weights, rate), []
        for step in range(steps):
            if step == steps * 2 // 3:
                adam.rate = rate / 4
            pick = rng.integers(0, len(x), batch)
            loss, gradient = self.gradients(x[pick], y[pick])
            adam.step({k: np.clip(g, -1, 1) for k, g in gradient.items()})
            losses.append(loss)
        return losses

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Most likely tags (B, T), by Viterbi."""
        trans = self.weights["trans"] + self.illegal
        emit = self._emissions(x)[0]
        length, n = emit.shape[:2]
        score, back = emit[0] + self.illegal_first, np.empty((length, n, self.n_tags), np.int8)
        for t in range(1, length):
            all_scores = score[:, :, None] + trans
            back[t] = all_scores.argmax(1)
            score = all_scores.max(1) + emit[t]
        tags = np.empty((n, length), np.int8)
        tags[:, -1] = score.argmax(1)
        for t in range(length - 1, 0, -1):
            tags[:, t - 1] = back[t, np.arange(n), tags[:, t]]
        return tags
