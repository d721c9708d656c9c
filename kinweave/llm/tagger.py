"""A character-level bidirectional LSTM with a CRF over its scores, in numpy: training by Adam, marginals, best paths."""

from __future__ import annotations

import numpy as np


def new_weights(symbols: int, tags: int, embed: int = 12, hidden: int = 10, seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = {"embed": rng.normal(0, 0.3, (symbols, embed)), "out": rng.normal(0, 0.2, (2 * hidden, tags)), "bias": np.zeros(tags), "step": np.zeros((tags, tags))}
    for d in "fb":
        w |= {f"x{d}": rng.normal(0, 0.3, (embed, 4 * hidden)), f"h{d}": rng.normal(0, 0.2, (hidden, 4 * hidden)), f"g{d}": np.zeros(4 * hidden)}
        w[f"g{d}"][hidden : 2 * hidden] = 1  # the forget gates begin open
    return w


def lstm(x: np.ndarray, w: dict, d: str) -> tuple[np.ndarray, list]:
    """States (T, B, H) over inputs (T, B, E) and what the backward pass needs."""
    hidden = w[f"h{d}"].shape[0]
    h = c = np.zeros((x.shape[1], hidden), x.dtype)
    gates, out, kept = x @ w[f"x{d}"] + w[f"g{d}"], np.empty((*x.shape[:2], hidden), x.dtype), []
    for t in range(len(x)):
        z = gates[t] + h @ w[f"h{d}"]
        z[:, : 3 * hidden] *= 0.5
        np.tanh(z, z)
        z[:, : 3 * hidden] += 1
        z[:, : 3 * hidden] *= 0.5  # sigmoids
        i, f, o, g = z[:, :hidden], z[:, hidden : 2 * hidden], z[:, 2 * hidden : 3 * hidden], z[:, 3 * hidden :]
        before, last = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[t] = h
        kept.append((i, f, o, g, before, last, tc))
    return out, kept


def lstm_back(x: np.ndarray, w: dict, d: str, kept: list, dout: np.ndarray, grad: dict) -> np.ndarray:
    dx, dh, dc = np.empty_like(x), 0.0, 0.0
    for t in range(len(x) - 1, -1, -1):
        i, f, o, g, before, last, tc = kept[t]
        dh = dout[t] + dh
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
        grad[f"x{d}"] += x[t].T @ dz
        grad[f"h{d}"] += last.T @ dz
        grad[f"g{d}"] += dz.sum(0)
        dx[t], dh, dc = dz @ w[f"x{d}"].T, dz @ w[f"h{d}"].T, dc * f
    return dx


def scores(codes: np.ndarray, w: dict) -> tuple[np.ndarray, tuple]:
    """Scores (T, B, tags) of codes (T, B)."""
    x = w["embed"][codes]
    forward, kf = lstm(x, w, "f")
    back, kb = lstm(x[::-1], w, "b")
    both = np.concatenate([forward, back[::-1]], 2)
    return both @ w["out"] + w["bias"], (x, both, kf, kb)


def loss_and_gradient(codes: np.ndarray, tags: np.ndarray, w: dict) -> tuple[float, dict]:
    """Mean negative log likelihood of the tags (T, B) under the CRF."""
    e, (x, both, kf, kb) = scores(codes, w)
    steps, batch, k = e.shape
    top = e.max(2, keepdims=True)
    p, move = np.exp(e - top), np.exp(w["step"])
    # forward and backward sums, scaled to one at each step
    a, b, size = np.empty_like(e), np.ones_like(e), np.empty_like(top)
    for t in range(steps):
        now = p[0] if t == 0 else (a[t - 1] @ move) * p[t]
        size[t] = now.sum(1, keepdims=True)
        a[t] = now / size[t]
    for t in range(steps - 2, -1, -1):
        b[t] = ((p[t + 1] * b[t + 1]) @ move.T) / size[t + 1]
    whole = (np.log(size) + top).sum()
    one = np.eye(k, dtype=e.dtype)[tags]
    gold = (e * one).sum() + w["step"][tags[:-1], tags[1:]].sum()
    de = (a * b - one) / batch
    grad = {n: np.zeros_like(v) for n, v in w.items()}
    pairs = move * (a[:-1].reshape(-1, k).T @ (p[1:] * b[1:] / size[1:]).reshape(-1, k))
    grad["step"] = (pairs - one[:-1].reshape(-1, k).T @ one[1:].reshape(-1, k)) / batch
    grad["out"], grad["bias"] = both.reshape(-1, both.shape[2]).T @ de.reshape(-1, k), de.sum((0, 1))
    dboth, hidden = de @ w["out"].T, w["hf"].shape[0]
    dx = lstm_back(x, w, "f", kf, dboth[:, :, :hidden], grad)
    dx += lstm_back(x[::-1], w, "b", kb, dboth[::-1, :, hidden:], grad)[::-1]
    np.add.at(grad["embed"], codes.ravel(), dx.reshape(-1, dx.shape[2]))
    return float((whole - gold) / batch), grad


class Reader:
    """The scores of many windows at a time, in single precision: what a symbol adds to the gates is looked up, and one
    tanh serves all four of them."""

    def __init__(self, w: dict):
        self.step, self.hidden = w["step"].astype(np.float32), w["hf"].shape[0]
        halves = np.ones(4 * self.hidden)
        halves[: 3 * self.hidden] = 0.5  # sigmoid(x) = (1 + tanh(x / 2)) / 2
        self.given = {d: ((w["embed"] @ w[f"x{d}"] + w[f"g{d}"]) * halves).astype(np.float32) for d in "fb"}
        self.kept = {d: (w[f"h{d}"] * halves).astype(np.float32) for d in "fb"}
        self.out, self.bias = w["out"].astype(np.float32), w["bias"].astype(np.float32)

    def states(self, codes: np.ndarray, d: str) -> np.ndarray:
        """(T, hidden, B): windows lie side by side, so that all gates are contiguous."""
        n, (steps, batch) = self.hidden, codes.shape
        h, c, out = np.zeros((n, batch), np.float32), np.zeros((n, batch), np.float32), np.empty((steps, n, batch), np.float32)
        given, kept = self.given[d], self.kept[d].T
        index = codes.astype(np.intp)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = kept @ h
            z += given.take(index[t], 0).T
            np.tanh(z, z)
            z[: 3 * n] += 1  # twice the three gates
            c *= z[n : 2 * n]
            c += z[:n] * z[3 * n :]
            c *= 0.5
            h = np.tanh(c)
            h *= z[2 * n : 3 * n]
            h *= 0.5
            out[t] = h
        return out

    def scores(self, codes: np.ndarray) -> np.ndarray:
        """Scores (T, tags, B) of codes (T, B)."""
        e = self.out[: self.hidden].T @ self.states(codes, "f")
        e += self.out[self.hidden :].T @ self.states(codes, "b")
        e += self.bias[:, None]
        return e

    def undecided(self, e: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The windows whose best path leaves the outside tag; symbol 0 is beyond the end. Scores are those over it.

        A bound with the best of all begin and of all inside tags settles most of them, the others take their best path."""
        step, outer = self.step - self.step[0, 0], e[:, 0]
        begin, inside = (np.maximum(np.maximum(e[:, k], e[:, k + 2]), np.maximum(e[:, k + 4], e[:, k + 6])) - outer if e.shape[1] == 9 else e[:, k::2].max(1) - outer for k in (1, 2))
        gone = codes == 0
        begin[gone] = inside[gone] = -1e6
        enter = np.maximum(begin + step[0, 1::2].max(), inside + step[0, 2::2].max())
        on = np.maximum(begin + step[1:, 1::2].max(), inside + step[1:, 2::2].max())
        best = path = np.maximum(begin[0], inside[0])
        for t in range(1, len(e)):
            path = np.maximum(enter[t], path + on[t])
            best = np.maximum(best, path)
        some = np.flatnonzero(best + max(0.0, float(step[1:, 0].max())) > 1e-3)
        rest = e[:, :, some] - outer[:, None, some]
        rest[:, 1:] -= 1e6 * (codes[:, None, some] == 0)
        best = rest[0]
        for t in range(1, len(rest)):
            best = (best[:, None] + step[:, :, None]).max(0)
            best += rest[t]
        out = np.zeros(codes.shape[1], bool)
        out[some] = best.max(0) > 1e-3
        return out


def trained(codes: np.ndarray, tags: np.ndarray, symbols: int, kinds: int, epochs: int = 6, batch: int = 40, rate: float = 0.03, seed: int = 5) -> dict:
    """Weights fitted to windows (N, T) of codes and tags; the same for the same input."""
    rng = np.random.default_rng(seed)
    w = {n: x.astype(np.float32) for n, x in new_weights(symbols, kinds, seed=seed).items()}
    m, v, step = {n: np.zeros_like(x) for n, x in w.items()}, {n: np.zeros_like(x) for n, x in w.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(codes))
        for a in range(0, len(order), batch):
            own, step = order[a : a + batch], step + 1
            _, grad = loss_and_gradient(codes[own].T, tags[own].T, w)
            size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            for n, g in grad.items():
                g = g * min(1.0, 5 / (size + 1e-9))
                m[n], v[n] = 0.9 * m[n] + 0.1 * g, 0.999 * v[n] + 0.001 * g * g
                w[n] = w[n] - np.float32(rate * (1 - epoch / epochs)) * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.999**step)) + 1e-8)
    return w


def best_paths(runs: list[np.ndarray], step: np.ndarray, most: int = 64) -> list[np.ndarray]:
    """The best tags of each run of scores (T, tags); runs of like lengths are solved together."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(runs)
    order = sorted(range(len(runs)), key=lambda i: len(runs[i]))
    for x in range(0, len(order), most):
        some = order[x : x + most]
        size = np.array([len(runs[i]) for i in some])
        steps, each = int(size[-1]), np.arange(len(some))
        e = np.zeros((steps, len(step), len(some)), np.float32)
        for c, i in enumerate(some):
            e[: size[c], :, c] = runs[i]
        back, at = np.zeros(e.shape, np.int8), e[0].copy() if steps else np.zeros((len(step), len(some)), np.float32)
        for t in range(1, steps):
            options = at[:, None] + step[:, :, None]
            back[t] = options.argmax(0)
            at = np.where(t < size, options.max(0) + e[t], at)
        tag = at.argmax(0)
        path = np.zeros((steps, len(some)), np.int64)
        for t in range(steps - 1, -1, -1):
            path[t] = tag
            tag = np.where((t < size) & (t > 0), back[t, tag, each], tag)
        for c, i in enumerate(some):
            out[i] = path[: size[c], c]
    return out
