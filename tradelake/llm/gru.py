"""A small gated recurrent language model in numpy, with a class-factored output.

Tokens are numbers: 0 .. HEAD - 1 for frequent tokens, HEAD + k for the rest,
known by their class k only. P(token) = P(class | state) * P(token | class),
where the second factor is a softmax over the state for frequent tokens, and
left to the caller for the rest. Number 0 is the end of a text and also what
comes before its first token.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

GROUP, GROUPS, TAIL = 32, 32, 64
HEAD, CLASSES = GROUP * GROUPS, GROUPS + TAIL
HIDDEN, WINDOW = 24, 32


def class_of(token: np.ndarray) -> np.ndarray:
    return np.where(token < HEAD, token // GROUP, token - HEAD + GROUPS)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Gru:
    p: dict[str, np.ndarray]

    @staticmethod
    def start(counts: np.ndarray, seed: int = 1) -> "Gru":
        """Weights that give every token its share of counts (one for each number) in every state."""
        rng = np.random.default_rng(seed)
        normal = lambda *shape: (rng.standard_normal(shape) * 0.15).astype(np.float32)
        c = np.maximum(counts, 0.5)
        by_class = np.bincount(class_of(np.arange(HEAD + TAIL)), c, CLASSES)
        return Gru({
            "x": normal(HEAD + TAIL, 3 * HIDDEN), "u": normal(HIDDEN, 3 * HIDDEN),
            "c": normal(HIDDEN, CLASSES) * 0, "cb": np.log(by_class / by_class.sum()).astype(np.float32),
            "w": normal(GROUPS, HIDDEN, GROUP) * 0,
            "wb": np.log(c[:HEAD] / by_class[: GROUPS].repeat(GROUP)).astype(np.float32).reshape(GROUPS, GROUP)})

    def step(self, h: np.ndarray, before: np.ndarray):
        """The next state, and what the way back needs."""
        x, hu = self.p["x"][before], h @ self.p["u"]
        g = _sigmoid(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
        r, z = g[:, :HIDDEN], g[:, HIDDEN:]
        n = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
        return n + z * (h - n), (h, r, z, n, hu[:, 2 * HIDDEN :])

    def outputs(self, h: np.ndarray, token: np.ndarray, grads: dict | None = None):
        """Natural log probabilities of tokens (of their class only, past HEAD); with grads also the slope by h."""
        cls = class_of(token)
        logits = h @ self.p["c"] + self.p["cb"]
        logits -= logits.max(1, keepdims=True)
        e = np.exp(logits)
        total = e.sum(1)
        rows = np.arange(len(token))
        out = logits[rows, cls] - np.log(total)
        back = None
        if grads is not None:
            e /= total[:, None]
            e[rows, cls] -= 1
            grads["c"] += h.T @ e
            grads["cb"] += e.sum(0)
            back = e @ self.p["c"].T
        by = np.argsort(cls, kind="stable")
        ends = np.searchsorted(cls[by], np.arange(GROUPS + 1))
        for k in range(GROUPS):
            at = by[ends[k] : ends[k + 1]]
            if not len(at):
                continue
            logits = h[at] @ self.p["w"][k] + self.p["wb"][k]
            logits -= logits.max(1, keepdims=True)
            e = np.exp(logits)
            total = e.sum(1)
            own = token[at] - k * GROUP
            out[at] += logits[np.arange(len(at)), own] - np.log(total)
            if grads is not None:
                e /= total[:, None]
                e[np.arange(len(at)), own] -= 1
                grads["w"][k] += h[at].T @ e
                grads["wb"][k] += e.sum(0)
                back[at] += e @ self.p["w"][k].T
        return out, back

    def slope(self, h: np.ndarray, before: np.ndarray, after: np.ndarray):
        """Loss and gradients over a window [time, lane], truncated at its start; and the last state."""
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        states, saved = [], []
        for t in range(len(before)):
            h = np.where((before[t] == 0)[:, None], np.float32(0), h)  # a new text
            h, s = self.step(h, before[t])
            states.append(h)
            saved.append(s)
        flat = np.concatenate(states)
        loss, back = self.outputs(flat, after.ravel(), grads)
        back = back.reshape(len(before), -1, HIDDEN)
        dh = np.zeros_like(h)
        for t in reversed(range(len(before))):
            prev, r, z, n, hn = saved[t]
            dh = dh + back[t]
            dn = dh * (1 - z) * (1 - n * n)
            da = np.concatenate([dn * hn * r * (1 - r), dh * (prev - n) * z * (1 - z), dn], 1)
            du = da.copy()
            du[:, 2 * HIDDEN :] *= r
            grads["u"] += prev.T @ du
            np.add.at(grads["x"], before[t], da)
            dh = np.where((before[t] == 0)[:, None], 0, dh * z + du @ self.p["u"].T)
        return -loss.mean(), {k: g / len(loss) for k, g in grads.items()}, h

    def learn(self, stream: np.ndarray, lanes: int, epochs: int, rate: float = 0.01) -> list[float]:
        """Truncated backpropagation over texts in a row, each ended by 0, cut into lanes; returns the loss of each window."""
        lanes = max(1, min(lanes, len(stream) // (40 * WINDOW)))
        length = -(-len(stream) // lanes)
        if not length:
            return []
        stream = np.resize(stream, length * lanes)  # the last lane is filled up from the start
        after = stream[: length * lanes].reshape(lanes, length).T
        before = np.concatenate([np.r_[0, stream[length - 1 : length * lanes - 1 : length]][None, :], after[:-1]])
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        losses, n = [], 0
        total = epochs * -(-length // WINDOW)
        for _ in range(epochs):
            h = np.zeros((lanes, HIDDEN), np.float32)
            for t in range(0, length, WINDOW):
                loss, grads, h = self.slope(h, before[t : t + WINDOW], after[t : t + WINDOW])
                n += 1
                now = rate * min(1, n / 20) * (1 - 0.9 * n / total)
                for k, g in grads.items():
                    g = np.clip(g, -0.5, 0.5)
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.005 * (g * g - v[k])
                    self.p[k] -= (now * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.995**n)) + 1e-7)).astype(np.float32)
                losses.append(float(loss))
        return losses

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of each text, whole: states go on from window to window, longest texts in the first lanes."""
        order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
        size = np.array([len(texts[k]) for k in order])
        out, h = np.zeros(len(texts)), np.zeros((len(texts), HIDDEN), np.float32)
        last = np.zeros(len(texts), np.int64)
        for t in range(0, int(size.max(initial=0)), WINDOW):
            live = int(np.searchsorted(-size, -t, "left"))
            width = min(WINDOW, int(size[0]) - t)
            after = np.zeros((width, live), np.int64)
            for lane in range(live):
                part = texts[order[lane]][t : t + width]
                after[: len(part), lane] = part
            h, states, targets, lanes = h[:live], [], [], []
            for s in range(width):
                n = int(np.searchsorted(-size[:live], -(t + s), "left"))
                h = h[:n]
                h, _ = self.step(h, last[:n])
                last[:n] = after[s, :n]
                states.append(h)
                targets.append(after[s, :n])
                lanes.append(np.arange(n))
            found, _ = self.outputs(np.concatenate(states), np.concatenate(targets))
            out[:live] += np.bincount(np.concatenate(lanes), found, live)
        result = np.zeros(len(texts))
        result[order] = out
        return result
