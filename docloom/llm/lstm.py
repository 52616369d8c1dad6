"""A bidirectional LSTM in numpy that gives each item of a sequence a probability."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


@dataclass
class BiLstm:
    """``wx, wh, b`` of each direction, and the weights of both states in the output."""

    forward: list[np.ndarray]
    backward: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    @staticmethod
    def new(width: int, hidden: int, rng: np.random.Generator) -> BiLstm:
        def direction():
            b = np.zeros(4 * hidden, np.float32)
            b[hidden : 2 * hidden] = 1  # keep what is remembered, to begin with
            return [(rng.standard_normal((n, 4 * hidden)) / np.sqrt(m)).astype(np.float32) for n, m in ((width, 40), (hidden, hidden))] + [b]

        return BiLstm(direction(), direction(), (rng.standard_normal(2 * hidden) / np.sqrt(hidden)).astype(np.float32), np.zeros(1, np.float32))

    @property
    def parameters(self) -> list[np.ndarray]:
        return [*self.forward, *self.backward, self.out, self.bias]

    @staticmethod
    def _run(pre: np.ndarray, mask: np.ndarray, wh: np.ndarray, keep: bool):
        """States over time; ``pre`` is (time, batch, 4 hidden). With ``keep``, what the gradient needs."""
        steps, n, width = pre.shape
        size = width // 4
        h, c = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32)
        states, held = np.empty((steps, n, size), np.float32), []
        for t in range(steps):
            z = pre[t] + h @ wh
            gates = _sigmoid(z[:, : 3 * size])
            i, f, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
            g = np.tanh(z[:, 3 * size :])
            m = mask[t][:, None]
            new = f * c + i * g
            tanh = np.tanh(new)
            if keep:
                held.append((h, c, i, f, o, g, tanh))
            c = np.where(m, new, c)
            h = np.where(m, o * tanh, h)
            states[t] = h
        return states, held

    def states(self, pre_f: np.ndarray, pre_b: np.ndarray, mask: np.ndarray, keep: bool = False):
        hf, kf = self._run(pre_f, mask, self.forward[1], keep)
        hb, kb = self._run(pre_b[::-1], mask[::-1], self.backward[1], keep)
        return np.concatenate([hf, hb[::-1]], axis=2), kf, kb

    def probabilities(self, pre_f: np.ndarray, pre_b: np.ndarray, mask: np.ndarray) -> np.ndarray:
        states, _, _ = self.states(pre_f, pre_b, mask)
        return _sigmoid(states @ self.out + self.bias[0])

    @staticmethod
    def _back(x, mask, dh_out, held, wh):
        steps, n, size = dh_out.shape
        dz_all = np.empty((steps, n, 4 * size), np.float32)
        dh, dc = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32)
        dwh = np.zeros_like(wh)
        for t in reversed(range(steps)):
            h, c, i, f, o, g, tanh = held[t]
            m = mask[t][:, None]
            dh = dh + dh_out[t]
            live = np.where(m, dh, 0)
            dnew = np.where(m, dc, 0) + live * o * (1 - tanh**2)
            dz = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), live * tanh * o * (1 - o), dnew * i * (1 - g**2)], axis=1)
            dz_all[t] = dz
            dwh += h.T @ dz
            dh = np.where(m, 0, dh) + dz @ wh.T
            dc = np.where(m, dnew * f, dc)
        flat = dz_all.reshape(-1, 4 * size)
        return [x.reshape(-1, x.shape[2]).T @ flat, dwh, flat.sum(axis=0)]

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean log loss over the items that ``mask`` has, and its gradient."""
        pre = [x @ w[0] + w[2] for w in (self.forward, self.backward)]
        states, kf, kb = self.states(*pre, mask, keep=True)
        z = states @ self.out + self.bias[0]
        n = mask.sum()
        loss = float((np.logaddexp(0, z) - y * z)[mask].sum() / n)
        dz = np.where(mask, _sigmoid(z) - y, 0).astype(np.float32) / n
        dh = dz[:, :, None] * self.out
        size = dh.shape[2] // 2
        gf = self._back(x, mask, dh[:, :, :size], kf, self.forward[1])
        gb = self._back(x[::-1], mask[::-1], dh[::-1, :, size:], kb, self.backward[1])
        return loss, [*gf, *gb, np.einsum("tbh,tb->h", states, dz), np.array([dz.sum()], np.float32)]


def train(model: BiLstm, batches, rounds: int, rate: float = 0.01) -> float:
    """Adam over ``batches(round)``, each ``(x, mask, y)`` with time first; the mean loss of the last round."""
    m = [np.zeros_like(p) for p in model.parameters]
    v = [np.zeros_like(p) for p in model.parameters]
    step, losses = 0, []
    for k in range(rounds):
        losses = []
        for x, mask, y in batches(k):
            loss, g = model.gradient(x, mask, y)
            norm = np.sqrt(sum(float((a * a).sum()) for a in g))
            step += 1
            lr = rate * (1 - k / rounds) ** 0.5
            for p, a, mm, vv in zip(model.parameters, g, m, v, strict=True):
                a = a * min(1.0, 5.0 / (norm + 1e-9))
                mm += 0.1 * (a - mm)
                vv += 0.001 * (a * a - vv)
                p -= (lr * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            losses.append(loss)
    return float(np.mean(losses))
