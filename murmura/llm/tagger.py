"""A character-level bidirectional LSTM with CRF transitions, forward and backward passes in numpy."""

from __future__ import annotations

import numpy as np

#: Input symbols, hidden units of a direction, tags (0 is outside; 2k + 1 begins kind k, 2k + 2 continues it), window.
SYMBOLS, HIDDEN, KINDS, WINDOW = 64, 16, ("email", "ip", "card", "phone"), 64
TAGS = 1 + 2 * len(KINDS)


def alphabet() -> np.ndarray:
    """Code points to symbols: a letter class by case, a class of digits, marks on their own, the rest together; 0 pads."""
    out = np.full(65536, 60, np.uint8)
    out[0], out[0x41:0x5B], out[0x61:0x7B], out[0x30:0x3A] = 0, 1, 2, 3
    out[0xC0:0x250] = 4
    for i, c in enumerate("@.+-_% ()\n\t,;:/\"'=#*&$!?|<>[]{}"):
        out[ord(c)] = 5 + i
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


class Tagger:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.p = {}
        for side in "fb":
            self.p[side + "x"] = rng.normal(0, 0.2, (SYMBOLS, 4 * h))
            self.p[side + "x"][:, h : 2 * h] += 1.0
            self.p[side + "h"] = rng.normal(0, 1 / np.sqrt(h), (h, 4 * h))
        self.p["o"] = rng.normal(0, 1 / np.sqrt(2 * h), (2 * h, TAGS))
        self.p["c"] = np.zeros(TAGS)
        self.p["t"] = np.zeros((TAGS, TAGS))
        for k in range(TAGS):  # a kind is continued only after it began
            self.p["t"][k, [j for j in range(2, TAGS, 2) if k not in (j, j - 1)]] = -4.0

    def _lstm(self, ids: np.ndarray, side: str, keep: bool):
        n, steps = ids.shape
        h = c = np.zeros((n, HIDDEN))
        out, memo = np.zeros((n, steps, HIDDEN)), []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = self.p[side + "x"][ids[:, t]] + h @ self.p[side + "h"]
            i, f, o = (_sigmoid(z[:, j * HIDDEN : (j + 1) * HIDDEN]) for j in (0, 1, 2))
            g = np.tanh(z[:, 3 * HIDDEN :])
            before, h0 = c, h
            c = f * c + i * g
            w = np.tanh(c)
            h = o * w
            out[:, t] = h
            if keep:
                memo.append((t, i, f, o, g, before, w, h0))
        return out, memo

    def _lstm_back(self, ids: np.ndarray, side: str, memo: list, grad: np.ndarray, out: dict) -> None:
        dh = dc = 0.0
        dx, dw = np.zeros((SYMBOLS, 4 * HIDDEN)), np.zeros((HIDDEN, 4 * HIDDEN))
        for t, i, f, o, g, before, w, h0 in reversed(memo):
            dh = dh + grad[:, t]
            dc = dc + dh * o * (1 - w * w)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * w * o * (1 - o), dc * i * (1 - g * g)], 1)
            dw += h0.T @ dz
            np.add.at(dx, ids[:, t], dz)
            dh, dc = dz @ self.p[side + "h"].T, dc * f
        out[side + "x"], out[side + "h"] = dx, dw

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._lstm(ids, "f", False)[0], self._lstm(ids, "b", False)[0]], 2)
        return both @ self.p["o"] + self.p["c"]

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood of the tags of whole windows, and its gradients."""
        n, steps = ids.shape
        (hf, mf), (hb, mb) = self._lstm(ids, "f", True), self._lstm(ids, "b", True)
        both = np.concatenate([hf, hb], 2)
        em, tr = both @ self.p["o"] + self.p["c"], self.p["t"]
        a, b = np.zeros((steps, n, TAGS)), np.zeros((steps, n, TAGS))
        a[0] = em[:, 0]
        for t in range(1, steps):
            a[t] = _sum_exp(a[t - 1][:, :, None] + tr[None], 1) + em[:, t]
        for t in range(steps - 2, -1, -1):
            b[t] = _sum_exp((b[t + 1] + em[:, t + 1])[:, None, :] + tr[None], 2)
        z = _sum_exp(a[-1], 1)
        rows, cols = np.arange(n)[:, None], np.arange(steps)[None, :]
        gold = em[rows, cols, tags].sum(1) + tr[tags[:, :-1], tags[:, 1:]].sum(1)
        de = np.exp(a + b - z[None, :, None]).transpose(1, 0, 2)
        de[rows, cols, tags] -= 1
        de /= n
        dt = np.zeros_like(tr)
        for t in range(1, steps):
            dt += np.exp(a[t - 1][:, :, None] + tr[None] + (em[:, t] + b[t] - z[:, None])[:, None, :]).sum(0)
        np.add.at(dt, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), -1)
        out = {"t": dt / n, "o": both.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, TAGS), "c": de.sum((0, 1))}
        dboth = de @ self.p["o"].T
        self._lstm_back(ids, "f", mf, dboth[:, :, :HIDDEN], out)
        self._lstm_back(ids, "b", mb, dboth[:, :, HIDDEN:], out)
        return float((z - gold).mean()), out

    def fit(self, ids: np.ndarray, tags: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 5) -> list[float]:
        """Adam over shuffled batches; the mean loss of each epoch."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        step, losses = 0, []
        for _ in range(epochs):
            order, total = rng.permutation(len(ids)), 0.0
            for s in range(0, len(order), batch):
                pick = order[s : s + batch]
                loss, grad = self.gradients(ids[pick], tags[pick])
                total += loss * len(pick)
                step += 1
                size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                for k, g in grad.items():
                    g = g * min(1.0, 5.0 / max(size, 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
            losses.append(total / max(1, len(ids)))
        return losses

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The best tag sequence of each window."""
        if not len(ids):
            return np.zeros(ids.shape, np.int64)
        em, tr = self.emissions(ids), self.p["t"]
        best, back = em[:, 0], []
        for t in range(1, ids.shape[1]):
            x = best[:, :, None] + tr[None]
            back.append(x.argmax(1))
            best = x.max(1) + em[:, t]
        out = np.zeros(ids.shape, np.int64)
        out[:, -1] = best.argmax(1)
        for t in range(ids.shape[1] - 2, -1, -1):
            out[:, t] = back[t][np.arange(len(ids)), out[:, t + 1]]
        return out
