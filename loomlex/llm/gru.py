"""A gated recurrent language model in numpy: truncated backpropagation, a softmax factored by classes, and states
that go on from window to window until a document ends.

Symbols are shortlisted words (numbers below SHORTLIST) and kinds of all other words, within which words keep their
relative frequencies. The softmax is over classes of CLASS_WORDS symbols each, then over the symbols of one class.
"""

from __future__ import annotations

import numpy as np

#: Words with weights of their own, in classes of CLASS_WORDS by frequency; kinds of all other words, in classes of
#: as many.
CLASS_WORDS = 32
SHORT_CLASSES = 32
SHORTLIST = CLASS_WORDS * SHORT_CLASSES
TAIL_CLASSES = 96
CLASSES = (SHORTLIST + TAIL_CLASSES) // CLASS_WORDS
HIDDEN = 16
#: Tokens of a window; every window is learnt from, and states pass on from one to the next.
WINDOW = 16
RATE = 0.05
FLOAT = np.float32


def start(word_counts: np.ndarray, tail_counts: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """Weights that give each word its frequency: words without counts get next to nothing."""
    rng = np.random.default_rng(seed)
    counts = np.zeros(SHORTLIST + TAIL_CLASSES)
    counts[: len(word_counts)], counts[SHORTLIST:] = word_counts, tail_counts
    table = np.maximum(counts, 1e-6).reshape(CLASSES, CLASS_WORDS)
    classes = table.sum(1)
    small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(FLOAT)
    return {
        "x": small(SHORTLIST + TAIL_CLASSES, 3 * HIDDEN),
        "u": small(HIDDEN, 3 * HIDDEN),
        "b": np.zeros(3 * HIDDEN, FLOAT),
        "wc": small(HIDDEN, CLASSES),
        "bc": np.log(classes / classes.sum()).astype(FLOAT),
        "wv": small(CLASSES, CLASS_WORDS, HIDDEN),
        "bv": np.log(table / classes[:, None]).astype(FLOAT),
    }


def lanes(lengths: np.ndarray, most: int, tokens: int) -> list[list[int]]:
    """Documents dealt to parallel lanes of some ``tokens`` each, the longest first to the lane with the least."""
    import heapq

    count = int(max(1, min(most, len(lengths), lengths.sum() // tokens + 1)))
    heap, out = [(0, k) for k in range(count)], [[] for _ in range(count)]
    for d in np.argsort(-lengths, kind="stable").tolist():
        n, k = heapq.heappop(heap)
        out[k].append(d)
        heapq.heappush(heap, (n + int(lengths[d]), k))
    return out


class Streams:
    """Lanes of whole documents as arrays of time by lane: tokens, where documents start, and what is padding."""

    def __init__(self, tokens: np.ndarray, starts: np.ndarray, lengths: np.ndarray, most: int, tokens_a_lane: int):
        # the longest lanes first, so that those still running are a leading slice
        dealt = sorted(lanes(lengths, most, tokens_a_lane), key=lambda d: -int(lengths[d].sum()))
        self.ends = np.array([int(lengths[d].sum()) for d in dealt])
        long = max(1, int(self.ends[0]))
        long = -(-long // WINDOW) * WINDOW
        self.tokens = np.zeros((long, len(dealt)), np.int32)
        self.first = np.zeros((long, len(dealt)), bool)
        self.place = np.full((long, len(dealt)), -1, np.int64)  # of the token in the flat array
        for k, docs in enumerate(dealt):
            at = 0
            for d in docs:
                n, s = int(lengths[d]), int(starts[d])
                self.tokens[at : at + n, k] = tokens[s : s + n]
                self.place[at : at + n, k] = np.arange(s, s + n)
                if n:
                    self.first[at, k] = True
                at += n

    def windows(self):
        for at in range(0, len(self.tokens), WINDOW):
            s, running = slice(at, at + WINDOW), int((self.ends > at).sum())
            yield self.tokens[s, :running], self.first[s, :running], self.place[s, :running]


def _normalise(logits: np.ndarray, at: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Natural log of the chance of the place ``at`` of each row, and the rows' sums; ``logits`` become exponentials.
    Rows are shifted only where exponentials need it."""
    if logits.size and max(float(logits.max()), -float(logits.min())) > 60:
        logits -= logits.max(1, keepdims=True)
    own = logits[at]
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], logits.dtype)
    return own - np.log(total), total


def _three(weights: np.ndarray) -> np.ndarray:
    """The columns of both gates and of the candidate, apart."""
    return np.ascontiguousarray(weights.reshape(len(weights), 3, HIDDEN).transpose(1, 0, 2))


class Network:
    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights
        self.seen = {k: np.full(v.shape, 1e-3, FLOAT) for k, v in weights.items()}

    def run(self, tokens: np.ndarray, first: np.ndarray, h: np.ndarray, keep: bool):
        """States before each token of a window, and the last one; with ``keep`` also what backpropagation needs: the
        gates and candidates, and what the state gave to the candidates. Each of the three is an array of its own, so
        that every step works on whole runs of memory."""
        w, n = self.w, HIDDEN
        # the gates' sums are halved beforehand, as a sigmoid is half of one plus the tanh of half
        half = np.repeat(np.array([0.5, 0.5, 1], FLOAT), n)
        table = _three((w["x"] + w["b"]) * half)
        u = _three(w["u"] * half)
        acts = np.empty((3, *tokens.shape, n), FLOAT)
        for whole, part in zip(acts, table):
            np.take(part, tokens, axis=0, out=whole, mode="clip")
        states, given = np.empty((*tokens.shape, n), FLOAT), np.empty((3, len(tokens) if keep else 1, *h.shape), FLOAT)
        fresh = first.any(1).tolist()
        h = h.copy()
        for t in range(len(tokens)):
            if fresh[t]:
                h[first[t]] = 0
            states[t] = h
            g, gates, c = given[:, t if keep else 0], acts[:2, t], acts[2, t]
            np.matmul(h, u, out=g)
            gates += g[:2]
            np.tanh(gates, out=gates)
            gates += 1
            gates *= FLOAT(0.5)
            z, r = gates
            c += r * g[2]
            np.tanh(c, out=c)
            step = c - h
            step *= z
            h += step
        return states, h, (acts, given[2]) if keep else ()

    def output(self, states: np.ndarray, targets: np.ndarray, grads: dict[str, np.ndarray] | None):
        """Natural log of the chance of each target: of its class and of the symbol in it. With ``grads`` the gradients
        are added and those of the states returned."""
        w = self.w
        cls = (targets // CLASS_WORDS).astype(np.uint8)
        # rows by class, so that a class's symbols are one product; small numbers are sorted by radix
        order = np.argsort(cls, kind="stable")
        cuts = np.searchsorted(cls[order], np.arange(CLASSES + 1)).tolist()
        some = [(k, i, j) for k, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j]
        rows = np.arange(len(order))
        of_class, of_symbol = (rows, cls[order]), (rows, targets[order] % CLASS_WORDS)
        # a column of ones takes the biases and their gradients along in the products
        s = np.ones((len(order), HIDDEN + 1), states.dtype)
        s[:, :-1] = states[order]
        logits = s @ np.concatenate([w["wc"], w["bc"][None]])
        words = np.concatenate([w["wv"], w["bv"][..., None]], 2)
        inner = np.empty((len(order), CLASS_WORDS), states.dtype)
        for k, i, j in some:
            np.matmul(s[i:j], words[k].T, out=inner[i:j])
        own, total = _normalise(logits, of_class)
        mine, inner_total = _normalise(inner, of_symbol)
        out = np.empty(len(order), own.dtype)
        out[order] = own + mine
        if grads is None:
            return out, None
        logits *= (1 / total)[:, None]
        logits[of_class] -= 1
        g = s.T @ logits
        grads["wc"] += g[:-1]
        grads["bc"] += g[-1]
        inner *= (1 / inner_total)[:, None]
        inner[of_symbol] -= 1
        more = np.empty((len(order), HIDDEN), states.dtype)
        for k, i, j in some:
            g = inner[i:j].T @ s[i:j]
            grads["wv"][k] += g[:, :-1]
            grads["bv"][k] += g[:, -1]
            np.matmul(inner[i:j], w["wv"][k], out=more[i:j])
        more += logits @ w["wc"].T
        back = np.empty_like(more)
        back[order] = more
        return out, back

    def learn(self, tokens: np.ndarray, first: np.ndarray, real: np.ndarray, h: np.ndarray) -> np.ndarray:
        """One window of backpropagation; returns the state after it."""
        w, n = self.w, HIDDEN
        states, last, ((z, r, c), gc) = self.run(tokens, first, h, True)
        grads = {k: np.zeros_like(v) for k, v in w.items() if k != "x"}
        flat, mask = states.reshape(-1, n), real.reshape(-1)
        if mask.all():
            _, back = self.output(flat, tokens.reshape(-1), grads)
        else:
            back = np.zeros_like(flat)
            _, back[mask] = self.output(flat[mask], tokens.reshape(-1)[mask], grads)
        back = back.reshape(states.shape)
        stay = 1 - z
        to_z, to_c = (c - states) * z * stay, z * (1 - c * c)
        to_r = gc * r * (1 - r)
        # of the sums of both gates, of what the state gives to the candidate, and of the candidate's sum
        dh, d = np.zeros_like(h), np.empty((4, *states.shape), FLOAT)
        out, fresh = _three(w["u"]).transpose(0, 2, 1).copy(), first.any(1).tolist()
        for t in range(len(tokens) - 1, -1, -1):
            dz, dr, dg, dc = d[:, t]
            np.multiply(dh, to_z[t], out=dz)
            np.multiply(dh, to_c[t], out=dc)
            np.multiply(dc, to_r[t], out=dr)
            np.multiply(dc, r[t], out=dg)
            dh *= stay[t]
            through = np.matmul(d[:3, t], out)
            for part in (*through, back[t]):
                dh += part
            if fresh[t]:
                dh[first[t]] = 0
        d = d.reshape(4, -1, n)
        grads["u"] = np.concatenate([flat.T @ x for x in d[:3]], 1)
        dx = np.concatenate((d[0], d[1], d[3]), 1)
        flat = tokens.reshape(-1)
        order = np.argsort(flat.astype(np.uint16), kind="stable")
        ranked = flat[order]
        at = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        some = ranked[at]
        grads["b"] = dx.sum(0)
        rows = np.add.reduceat(dx[order], at, axis=0)
        scale = FLOAT(1 / max(1, mask.sum()))
        for k, g in grads.items():
            g *= scale
            self.seen[k] += g * g
            w[k] -= FLOAT(RATE) * g / np.sqrt(self.seen[k])
        rows *= scale
        self.seen["x"][some] += rows * rows
        w["x"][some] -= FLOAT(RATE) * rows / np.sqrt(self.seen["x"][some])
        return last


def train(network: Network, tokens: np.ndarray, starts: np.ndarray, lengths: np.ndarray, most: int = 128) -> None:
    """One pass over whole documents; every token is in one window of backpropagation."""
    if not len(lengths) or not lengths.sum():
        return
    streams = Streams(tokens, starts, lengths, most, 6000)
    h = np.zeros((streams.tokens.shape[1], HIDDEN), FLOAT)
    for t, first, place in streams.windows():
        h = network.learn(t, first, place >= 0, h[: t.shape[1]])


def score(network: Network, tokens: np.ndarray, starts: np.ndarray, lengths: np.ndarray, most: int = 512) -> np.ndarray:
    """Natural log of the chance of each token of whole documents, in the order of ``tokens``."""
    out = np.zeros(len(tokens), FLOAT)
    if not len(tokens):
        return out
    streams = Streams(tokens, starts, lengths, most, 1500)
    h = np.zeros((streams.tokens.shape[1], HIDDEN), FLOAT)
    for t, first, place in streams.windows():
        states, h, _ = network.run(t, first, h[: t.shape[1]], False)
        mask = place >= 0
        out[place[mask]], _ = network.output(states[mask], t[mask], None)
    return out
