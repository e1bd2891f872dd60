"""A character tagger in numpy: bidirectional LSTM, CRF transitions, Adam.

Small enough to be fitted on the driver from a bounded set of labelled windows and to be
sent to every task.
"""

from __future__ import annotations

import numpy as np

KINDS = ("email", "ip", "card", "phone")
# Tag 0 is outside; kind k begins with 2k + 1 and goes on with 2k + 2.
TAGS = 2 * len(KINDS) + 1
PAD, OTHER = 0, 1


def classes(codes: np.ndarray) -> np.ndarray:
    """Class of each code point: printable ASCII for itself, digits alike, letters uncased."""
    out = np.full(codes.shape, OTHER, np.int64)
    plain = (codes >= 32) & (codes < 127)
    out[plain] = codes[plain] - 30
    upper = (codes >= 65) & (codes <= 90)
    out[upper] = codes[upper] + 32 - 30
    out[(codes >= 48) & (codes <= 57)] = 48 - 30
    out[(codes == 10) | (codes == 9) | (codes == 13)] = 32 - 30
    out[codes == 0] = PAD
    return out


N_CLASSES = 98


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    """Parameters by name; ``f`` and ``b`` are the two directions."""

    def __init__(self, hidden: int = 16, seed: int = 3, params: dict | None = None):
        self.h = hidden
        if params is not None:
            self.p = params
            return
        rng = np.random.default_rng(seed)
        p = {}
        for d in "fb":
            p["E" + d] = rng.normal(0, 0.3, (N_CLASSES, 4 * hidden))
            p["E" + d][:, hidden : 2 * hidden] += 1.0  # remember at first
            p["U" + d] = rng.normal(0, hidden**-0.5, (hidden, 4 * hidden))
        p["W"] = rng.normal(0, (2 * hidden) ** -0.5, (2 * hidden, TAGS))
        p["w"] = np.zeros(TAGS)
        p["A"] = rng.normal(0, 0.1, (TAGS, TAGS))
        p["w"][0] = 1.0
        self.p = p

    def _lstm(self, x: np.ndarray, d: str, keep: bool = False):
        """States for each place of class ids ``x``; with ``keep`` also what to go back on."""
        n, steps = x.shape
        h, c = np.zeros((n, self.h)), np.zeros((n, self.h))
        out, saved, k = np.empty((steps, n, self.h)), [], 3 * self.h
        E, U = self.p["E" + d], self.p["U" + d]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = E[x[:, t]] + h @ U
            gates, new = _sigmoid(z[:, :k]), np.tanh(z[:, k:])
            i, f, o = np.split(gates, 3, axis=1)
            before, prev = c, h
            c = f * c + i * new
            squashed = np.tanh(c)
            h = o * squashed
            out[t] = h
            if keep:
                saved.append((t, i, f, o, new, before, squashed, prev))
        return out, saved

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Tag scores, places first."""
        both = np.concatenate([self._lstm(x, d)[0] for d in "fb"], axis=2)
        return both @ self.p["W"] + self.p["w"]

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags per window, and each place's score over that of being outside."""
        e, A = self.scores(x), self.p["A"]
        steps, n, _ = e.shape
        best, back = e[0], np.empty((steps, n, TAGS), np.int8)
        for t in range(1, steps):
            total = best[:, :, None] + A
            back[t] = total.argmax(axis=1)
            best = total.max(axis=1) + e[t]
        tags = np.empty((n, steps), np.int64)
        tags[:, -1] = best.argmax(axis=1)
        rows = np.arange(n)
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = back[t, rows, tags[:, t]]
        over = np.take_along_axis(e, tags.T[:, :, None], 2)[:, :, 0] - e[:, :, 0]
        return tags, over.T

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood of the tags ``y``, and its gradient."""
        n, steps = x.shape
        kept = {d: self._lstm(x, d, keep=True) for d in "fb"}
        both = np.concatenate([kept[d][0] for d in "fb"], axis=2)
        e, A = both @ self.p["W"] + self.p["w"], self.p["A"]
        ahead, behind = [e[0]], [np.zeros((n, TAGS))]
        for t in range(1, steps):
            ahead.append(_logsum(ahead[-1][:, :, None] + A, 1) + e[t])
        for t in range(steps - 1, 0, -1):
            behind.append(_logsum(A + (e[t] + behind[-1])[:, None, :], 2))
        behind = behind[::-1]
        whole = _logsum(ahead[-1], 1)
        rows = np.arange(n)
        gold = sum(e[t][rows, y[:, t]].sum() for t in range(steps))
        gold += A[y[:, :-1], y[:, 1:]].sum()
        de = np.stack([np.exp(a + b - whole[:, None]) for a, b in zip(ahead, behind, strict=True)])
        dA = np.zeros_like(A)
        pair = np.stack(ahead[:-1])[..., None] + A + (e[1:] + np.stack(behind[1:]))[:, :, None, :]
        dA += np.exp(pair - whole[:, None, None]).sum(axis=(0, 1))
        np.add.at(dA, (y[:, :-1], y[:, 1:]), -1)
        for t in range(steps):
            de[t][rows, y[:, t]] -= 1
        de /= n
        grads = {"A": dA / n, "w": de.sum((0, 1))}
        grads["W"] = np.tensordot(both, de, ((0, 1), (0, 1)))
        dboth = de @ self.p["W"].T
        for d, part in zip("fb", np.split(dboth, 2, axis=2), strict=True):
            grads |= self._back(x, d, part, kept[d][1])
        return float((whole.sum() - gold) / n), grads

    def _back(self, x: np.ndarray, d: str, dout: np.ndarray, saved: list) -> dict:
        U = self.p["U" + d]
        places, changes, before_them = [], [], []
        dh, dc = np.zeros((len(x), self.h)), np.zeros((len(x), self.h))
        for t, i, f, o, new, before, squashed, prev in reversed(saved):
            dh = dh + dout[t]
            dc = dc + dh * o * (1 - squashed**2)
            dz = np.concatenate(
                [
                    dc * new * i * (1 - i),
                    dc * before * f * (1 - f),
                    dh * squashed * o * (1 - o),
                    dc * i * (1 - new**2),
                ],
                axis=1,
            )
            places.append(x[:, t])
            changes.append(dz)
            before_them.append(prev)
            dh, dc = dz @ U.T, dc * f
        dz, hot = np.concatenate(changes), np.concatenate(places)
        dE = (np.arange(N_CLASSES)[:, None] == hot).astype(float) @ dz
        return {"E" + d: dE, "U" + d: np.concatenate(before_them).T @ dz}

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int, rate: float, seed: int) -> None:
        """Adam on random batches; the same rows and seed give the same parameters."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        for t in range(1, steps + 1):
            pick = rng.choice(len(x), min(batch, len(x)), replace=False)
            _, grads = self.loss(x[pick], y[pick])
            norm = np.sqrt(sum((g**2).sum() for g in grads.values()))
            slow = rate * (1 - 0.9 * t / steps)
            for k, g in grads.items():
                g = g * min(1.0, 5 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g**2
                self.p[k] -= slow * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.log(np.exp(a - top).sum(axis=axis)) + top.squeeze(axis)
