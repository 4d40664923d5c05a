"""A character-level bidirectional LSTM with CRF transitions in numpy: training by gradient, decoding in batches."""

from __future__ import annotations

import numpy as np

#: Labels in the order in which they are listed; 0 is no personal data.
KINDS = ["email", "ip", "card", "phone"]
LABELS = 1 + len(KINDS)
HIDDEN = 24
#: Character classes: each small letter (capitals alike) and ASCII mark has its own; all digits share one, and so do
#: white space, letters beyond ASCII and the rest.
_TABLE = np.full(128, 3, np.uint8)
_TABLE[48:58] = 0
_TABLE[[9, 10, 11, 12, 13, 32]] = 1
_own = [chr(c) for c in range(33, 127) if not chr(c).isdigit() and not "A" <= chr(c) <= "Z"]
for _i, _c in enumerate(_own):
    _TABLE[ord(_c)] = _TABLE[ord(_c.upper()) if _c.isalpha() else ord(_c)] = 4 + _i
CLASSES = 4 + len(_own)
PAD = 1


def classes_of(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(code < 128, _TABLE[np.minimum(code, 127)], 2).astype(np.uint8)


class Tagger:
    """Weights: x (2, CLASSES, 4H) and u (2, H, 4H) of both directions, with gates in the order in, forget, out, new;
    out (2, H, LABELS); change (LABELS, LABELS)."""

    names = ("x", "u", "out", "bias", "change")

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls, seed: int = 3) -> Tagger:
        r, h = np.random.default_rng(seed), HIDDEN
        x = r.normal(0, 0.4, (2, CLASSES, 4 * h))
        x[:, :, h : 2 * h] += 1
        return cls({"x": x, "u": r.normal(0, 0.3, (2, h, 4 * h)), "out": r.normal(0, 0.3, (2, h, LABELS)), "bias": np.array([1.0] + [0.0] * (LABELS - 1)), "change": np.eye(LABELS)})

    def emissions(self, c: np.ndarray) -> np.ndarray:
        """(T, B, LABELS) scores of windows c: (B, T) classes."""
        b, t_all = c.shape
        h = HIDDEN
        half = np.ones(4 * h, np.float32)
        half[: 3 * h] = 0.5
        x, u = (self.w[k].astype(np.float32) * half for k in ("x", "u"))
        out = self.w["out"].astype(np.float32)
        score = np.zeros((t_all, b, LABELS), np.float32) + self.w["bias"].astype(np.float32)
        hid, cell = np.zeros((2, b, h), np.float32), np.zeros((2, b, h), np.float32)
        g, ct = np.empty((2, b, 4 * h), np.float32), np.ascontiguousarray(c.T)
        for t in range(t_all):
            np.matmul(hid, u, out=g)
            g[0] += x[0][ct[t]]
            g[1] += x[1][ct[t_all - 1 - t]]
            np.tanh(g, out=g)
            g[:, :, : 3 * h] *= 0.5
            g[:, :, : 3 * h] += 0.5
            cell *= g[:, :, h : 2 * h]
            cell += g[:, :, :h] * g[:, :, 3 * h :]
            np.multiply(g[:, :, 2 * h : 3 * h], np.tanh(cell), out=hid)
            score[t] += hid[0] @ out[0]
            score[t_all - 1 - t] += hid[1] @ out[1]
        return score

    def decode(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(best labels (B, T), each one's marginal probability (B, T)). Windows in which no place can gain by leaving label 0 are
        all 0 (given as certain); only the others are searched."""
        score = self.emissions(c)
        change = self.w["change"].astype(np.float32)
        t_all, b, n = score.shape
        labels = np.zeros((b, t_all), np.uint8)
        gain = score[:, :, 1:].max(2) - score[:, :, 0] + max(0.0, float(change.max() - change[0, 0]))
        some = np.flatnonzero((gain > 0).any(0))
        sure = np.ones((b, t_all))
        if len(some):
            s = score[:, some]
            best, back = s[0], np.empty((t_all, len(some), n), np.uint8)
            for t in range(1, t_all):
                ways = best[:, :, None] + change
                back[t] = ways.argmax(1)
                best = ways.max(1) + s[t]
            now = best.argmax(1)
            for t in range(t_all - 1, -1, -1):
                labels[some, t] = now
                now = back[t][np.arange(len(some)), now]
            prob = self._marginals(s.astype(np.float64))[0]
            sure[some] = np.take_along_axis(prob, labels[some].T[:, :, None].astype(np.int64), 2)[:, :, 0].T
        return labels, sure

    def _marginals(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(marginals, forward sums, backward sums, log partition) of the CRF over scores (T, B, LABELS)."""
        change = self.w["change"]
        ways = np.exp(np.stack([change, change.T]))
        both = np.stack([score, score[::-1]], 1)  # forward, and backward from the end, in one pass
        for t in range(1, len(score)):
            top = both[t - 1].max(2, keepdims=True)
            both[t] += top + np.log(np.exp(both[t - 1] - top) @ ways)
        alpha, beta = both[:, 0], both[::-1, 1] - score
        whole = _lse(alpha[-1], 1)
        return np.exp(alpha + beta - whole[:, None]), alpha, beta, whole

    def gradient(self, c: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of label paths y (B, T), and its gradient."""
        w, h = self.w, HIDDEN
        b, t_all = c.shape
        seq = np.stack([c, c[:, ::-1]])
        kind = w["u"].dtype
        hids, cells, gates, tans = [np.zeros((2, b, h), kind)], [np.zeros((2, b, h), kind)], [], []
        half = np.ones(4 * h, kind)
        half[: 3 * h] = 0.5
        x, u = w["x"] * half, w["u"] * half
        into = np.stack([x[d][seq[d].T] for d in (0, 1)], 1)
        for t in range(t_all):
            g = np.tanh(into[t] + hids[-1] @ u)
            g[:, :, : 3 * h] *= 0.5
            g[:, :, : 3 * h] += 0.5
            cell = g[:, :, h : 2 * h] * cells[-1] + g[:, :, :h] * g[:, :, 3 * h :]
            tan = np.tanh(cell)
            gates.append(g), cells.append(cell), tans.append(tan), hids.append(g[:, :, 2 * h : 3 * h] * tan)
        ahead, behind = np.stack([x[0] for x in hids[1:]]), np.stack([x[1] for x in hids[1:]])[::-1]
        score = ahead @ w["out"][0] + behind @ w["out"][1] + w["bias"]
        change = w["change"]
        prob, alpha, beta, whole = self._marginals(score)
        gold = np.eye(LABELS, dtype=kind)[y.T]
        pairs = np.exp(alpha[:-1, :, :, None] + change + (score[1:] + beta[1:])[:, :, None, :] - whole[:, None, None]).sum((0, 1))
        seen = np.zeros((LABELS, LABELS))
        np.add.at(seen, (y[:, :-1], y[:, 1:]), 1.0)
        gold_score = (score * gold).sum() + (seen * change).sum()
        loss = (whole.sum() - gold_score) / b
        ds = (prob - gold) / b
        grad = {"change": (pairs - seen) / b, "bias": ds.sum((0, 1)), "out": np.stack([np.einsum("tbh,tbl->hl", ahead, ds), np.einsum("tbh,tbl->hl", behind, ds)])}
        dh_all = np.stack([ds @ w["out"][0].T, (ds @ w["out"][1].T)[::-1]], 1)
        gu, dgs = np.zeros_like(w["u"]), np.empty((2, t_all, b, 4 * h), kind)
        dh, dc = np.zeros((2, b, h), kind), np.zeros((2, b, h), kind)
        for t in range(t_all - 1, -1, -1):
            g, tan = gates[t], tans[t]
            i, f, o, n = g[:, :, :h], g[:, :, h : 2 * h], g[:, :, 2 * h : 3 * h], g[:, :, 3 * h :]
            dh = dh + dh_all[t]
            dc = dc + dh * o * (1 - tan * tan)
            dg = np.concatenate([dc * n * i * (1 - i), dc * cells[t] * f * (1 - f), dh * tan * o * (1 - o), dc * i * (1 - n * n)], 2)
            dgs[:, t] = dg
            gu += hids[t].transpose(0, 2, 1) @ dg
            dh, dc = dg @ w["u"].transpose(0, 2, 1), dc * f
        every = np.eye(CLASSES, dtype=kind)
        gx = np.stack([every[seq[d].T.ravel()].T @ dgs[d].reshape(t_all * b, 4 * h) for d in (0, 1)])
        return float(loss), grad | {"x": gx, "u": gu}

    def fit(self, windows: np.ndarray, labels: np.ndarray, steps: int, batch: int, rate: float, seed: int = 5) -> Tagger:
        """Adam over random batches in single precision, the rate falling to a tenth."""
        self.w = {k: x.astype(np.float32) for k, x in self.w.items()}
        r = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(2))
        for t in range(1, steps + 1):
            pick = r.integers(0, len(windows), batch)
            _, grad = self.gradient(windows[pick], labels[pick])
            norm = np.sqrt(sum((g * g).sum() for g in grad.values()))
            now = rate * (1 - 0.9 * t / steps)
            for k, g in grad.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                self.w[k] -= now * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
        self.w = {k: x.astype(np.float64) for k, x in self.w.items()}
        return self


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)
