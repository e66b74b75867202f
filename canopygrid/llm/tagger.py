"""A character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ALPHABET = 100  # ids: 0 padding, 1..95 printable ASCII, then four classes of other characters


def char_ids(text: str) -> np.ndarray:
    """One id per code point."""
    cp = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    ids = np.where((cp >= 32) & (cp < 127), cp - 31, 0).astype(np.int64)
    for i in np.nonzero(ids == 0)[0]:
        c = chr(cp[i])
        ids[i] = 96 if c.isalpha() else 97 if c.isdigit() else 98 if c.isspace() else 99
    return ids


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class Tagger:
    """Parameters by name; ``tags`` tag ids, 0 being outside."""

    p: dict[str, np.ndarray]
    tags: int

    @classmethod
    def new(cls, tags: int, hidden: int = 16, emb: int = 12, seed: int = 7) -> Tagger:
        r = np.random.default_rng(seed)
        mat = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s)
        p = {"emb": r.normal(0, 0.3, (ALPHABET, emb)), "out": mat(2 * hidden, tags), "bias": np.zeros(tags),
             "move": np.zeros((tags, tags)), "first": np.zeros(tags)}
        for d in "fb":
            p |= {f"x{d}": mat(emb, 4 * hidden), f"h{d}": mat(hidden, 4 * hidden), f"g{d}": np.zeros(4 * hidden)}
            p[f"g{d}"][hidden:2 * hidden] = 1.0  # remember at first
        return cls(p, tags)

    def _lstm(self, ids: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """States (batch, time, hidden) of one direction; padding leaves the state as it is."""
        p, (n, t) = self.p, ids.shape
        h = p[f"h{d}"].shape[0]
        table = p["emb"] @ p[f"x{d}"] + p[f"g{d}"]
        hs, cs, memo = np.zeros((n, h)), np.zeros((n, h)), []
        out = np.zeros((n, t, h))
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            z = table[ids[:, k]] + hs @ p[f"h{d}"]
            i, f, o = _sigmoid(z[:, :h]), _sigmoid(z[:, h:2 * h]), _sigmoid(z[:, 2 * h:3 * h])
            g, m = np.tanh(z[:, 3 * h:]), mask[:, k, None]
            c = f * cs + i * g
            tc = np.tanh(c)
            if keep:
                memo.append((k, hs, cs, i, f, o, g, tc, m))
            hs, cs = m * (o * tc) + (1 - m) * hs, m * c + (1 - m) * cs
            out[:, k] = hs
        return out, memo

    def _lstm_back(self, ids: np.ndarray, d: str, memo: list, dout: np.ndarray, grad: dict) -> None:
        p = self.p
        h = p[f"h{d}"].shape[0]
        dh, dc = np.zeros_like(memo[0][1]), np.zeros_like(memo[0][1])
        dz_table = np.zeros((ALPHABET, 4 * h))
        for k, hs, cs, i, f, o, g, tc, m in reversed(memo):
            dh = dh + dout[:, k]
            dc_new = m * (dc + dh * o * (1 - tc * tc))
            dz = np.concatenate([dc_new * g * i * (1 - i), dc_new * cs * f * (1 - f), m * dh * tc * o * (1 - o),
                                 dc_new * i * (1 - g * g)], axis=1)
            np.add.at(dz_table, ids[:, k], dz)
            grad[f"h{d}"] += hs.T @ dz
            dh = dz @ p[f"h{d}"].T + (1 - m) * dh
            dc = dc_new * f + (1 - m) * dc
        grad[f"x{d}"] += p["emb"].T @ dz_table
        grad[f"g{d}"] += dz_table.sum(axis=0)
        grad["emb"] += dz_table @ p[f"x{d}"].T

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """Tag scores (batch, time, tags) before the transitions."""
        mask = (ids > 0).astype(float)
        both = np.concatenate([self._lstm(ids, mask, d, False)[0] for d in "fb"], axis=2)
        return both @ self.p["out"] + self.p["bias"]

    def loss_and_grad(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tag paths, and its gradient."""
        p, mask = self.p, (ids > 0).astype(float)
        (hf, mf), (hb, mb) = (self._lstm(ids, mask, d, True) for d in "fb")
        both = np.concatenate([hf, hb], axis=2)
        e = both @ p["out"] + p["bias"]
        n, t, k = e.shape
        a, b = np.zeros((n, t, k)), np.zeros((n, t, k))
        a[:, 0] = p["first"] + e[:, 0]
        for s in range(1, t):
            step = _logsum(a[:, s - 1, :, None] + p["move"], 1) + e[:, s]
            a[:, s] = np.where(mask[:, s, None] > 0, step, a[:, s - 1])
        for s in range(t - 2, -1, -1):
            step = _logsum(p["move"] + (e[:, s + 1] + b[:, s + 1])[:, None, :], 2)
            b[:, s] = np.where(mask[:, s + 1, None] > 0, step, b[:, s + 1])
        z = _logsum(a[:, -1], 1)
        one = np.eye(k)[tags]
        real = (one * e).sum(axis=2) * mask
        pair_mask = mask[:, 1:]
        gold = real.sum(axis=1) + p["first"][tags[:, 0]] + (p["move"][tags[:, :-1], tags[:, 1:]] * pair_mask).sum(axis=1)
        grad = {q: np.zeros_like(v) for q, v in p.items()}
        de = (np.exp(a + b - z[:, None, None]) - one) * mask[:, :, None] / n
        for s in range(1, t):
            both_tags = np.exp(a[:, s - 1, :, None] + p["move"] + (e[:, s] + b[:, s])[:, None, :] - z[:, None, None])
            grad["move"] += (both_tags * mask[:, s, None, None]).sum(axis=0) / n
        np.add.at(grad["move"], (tags[:, :-1][pair_mask > 0], tags[:, 1:][pair_mask > 0]), -1.0 / n)
        grad["first"] = de[:, 0].sum(axis=0)
        flat = both.reshape(n * t, -1)
        grad["out"], grad["bias"] = flat.T @ de.reshape(n * t, k), de.sum(axis=(0, 1))
        dboth = de @ p["out"].T
        h = hf.shape[2]
        self._lstm_back(ids, "f", mf, dboth[:, :, :h], grad)
        self._lstm_back(ids, "b", mb, dboth[:, :, h:], grad)
        return float((z - gold).mean()), grad

    def fit(self, ids: np.ndarray, tags: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.02,
            seed: int = 11) -> list[float]:
        """Adam over shuffled batches; the mean loss of each epoch."""
        r, m1, m2, step, losses = np.random.default_rng(seed), {}, {}, 0, []
        for _ in range(epochs):
            order, total = r.permutation(len(ids)), 0.0
            for at in range(0, len(ids), batch):
                pick = order[at:at + batch]
                loss, grad = self.loss_and_grad(ids[pick], tags[pick])
                total += loss * len(pick)
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                step += 1
                for q, g in grad.items():
                    g = g * min(1.0, 5.0 / (norm + 1e-9))
                    m1[q] = 0.9 * m1.get(q, 0.0) + 0.1 * g
                    m2[q] = 0.999 * m2.get(q, 0.0) + 0.001 * g * g
                    self.p[q] -= rate * (m1[q] / (1 - 0.9**step)) / (np.sqrt(m2[q] / (1 - 0.999**step)) + 1e-8)
            losses.append(total / max(1, len(ids)))
        return losses

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tag path of each window (Viterbi) and, per position, its lead over the outside tag."""
        e, mask = self.scores(ids), ids > 0
        n, t, k = e.shape
        best, back = self.p["first"] + e[:, 0], np.zeros((n, t, k), dtype=np.int64)
        for s in range(1, t):
            step = best[:, :, None] + self.p["move"]
            back[:, s] = np.where(mask[:, s, None], step.argmax(axis=1), np.arange(k))
            best = np.where(mask[:, s, None], step.max(axis=1) + e[:, s], best)
        path = np.zeros((n, t), dtype=np.int64)
        path[:, -1] = best.argmax(axis=1)
        for s in range(t - 1, 0, -1):
            path[:, s - 1] = np.take_along_axis(back[:, s], path[:, s, None], axis=1)[:, 0]
        lead = np.take_along_axis(e, path[:, :, None], axis=2)[:, :, 0] - e[:, :, 0]
        return np.where(mask, path, 0), lead
