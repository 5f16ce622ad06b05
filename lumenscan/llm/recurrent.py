"""A bidirectional gated recurrent network with attention pooling, in numpy.

The input of a step is one token: an embedding of the hashed word beside the mean embedding of
its hashed character trigrams. A window of tokens gives one logit.
"""

from __future__ import annotations

import zlib

import numpy as np

WORDS, GRAMS = 1 << 15, 1 << 14
#: Characters of a token; longer words are several tokens.
TOKEN_CHARS = 24
#: Tokens whose projections a worker remembers.
KNOWN_TOKENS = 50_000


def tokens_of(text: str) -> list[str]:
    """Lower-case words between white space, cut every TOKEN_CHARS characters."""
    words = text.lower().split()
    if words and max(map(len, words)) > TOKEN_CHARS:
        words = [w[i : i + TOKEN_CHARS] for w in words for i in range(0, len(w), TOKEN_CHARS)]
    return words


def windows_of(n: int, size: int, stride: int) -> list[int]:
    """Where the overlapping windows over ``n`` tokens begin; the last one reaches the end."""
    return list(range(0, max(n - size, 0) + stride, stride))[: max(1, -(-(n - size) // stride) + 1)] if n else []


def features(tokens: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The word bucket of each token, and groups (places, trigram buckets) of tokens of one length."""
    raw = [t.encode("utf-8", "surrogatepass") for t in tokens]
    bare = [b.strip(b".,;:!?\"'()[]") or b for b in raw]
    words = np.fromiter((zlib.crc32(b) & (WORDS - 1) for b in bare), np.int64, len(raw))
    sizes = np.fromiter(map(len, bare), np.int64, len(raw))
    groups = []
    for size in np.unique(sizes):
        places = np.flatnonzero(sizes == size)
        data = np.frombuffer(b"".join(b"\2" + bare[i] + b"\3" for i in places), np.uint8).reshape(len(places), size + 2).astype(np.uint32)
        grams = data[:, :-2] * np.uint32(0x9E3779B1) + data[:, 1:-1] * np.uint32(0x85EBCA77) + data[:, 2:] * np.uint32(0xC2B2AE3D)
        groups.append((places, (grams ^ (grams >> np.uint32(15))).astype(np.int64) & (GRAMS - 1)))
    return words, groups


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Network:
    """Parameters, and the passes over windows given as token places (T, W), longest window first."""

    def __init__(self, hidden: int = 16, width: int = 16, seed: int = 7):
        draw = np.random.default_rng(seed)
        normal = lambda *shape, scale: (draw.standard_normal(shape) * scale).astype(np.float32)
        self.hidden, h = hidden, hidden
        self.p = {
            "words": normal(WORDS, width, scale=0.02),
            "grams": normal(GRAMS, width, scale=0.3),
            "in": normal(2 * width, 6 * h, scale=1 / np.sqrt(2 * width)),
            "in_bias": np.zeros(6 * h, np.float32),
            "forward": normal(h, 3 * h, scale=1 / np.sqrt(h)),
            "backward": normal(h, 3 * h, scale=1 / np.sqrt(h)),
            "attend": normal(2 * h, scale=0.3),
            "out": normal(2 * h, scale=0.3),
            "out_bias": np.zeros(1, np.float32),
        }

    def embed(self, tokens: list[str]) -> tuple[np.ndarray, tuple]:
        words, groups = features(tokens)
        width = self.p["words"].shape[1]
        x = np.empty((len(tokens), 2 * width), np.float32)
        x[:, :width] = self.p["words"][words]
        for places, grams in groups:
            for at in range(0, len(places), 4096):
                x[places[at : at + 4096], width:] = self.p["grams"][grams[at : at + 4096]].mean(axis=1)
        return x, (words, groups)

    def project(self, x: np.ndarray) -> np.ndarray:
        return x @ self.p["in"] + self.p["in_bias"]

    def _pass(self, inputs: np.ndarray, places: np.ndarray, active: np.ndarray, weights: np.ndarray, steps, keep: bool):
        h = self.hidden
        states = np.zeros((len(places), places.shape[1], h), np.float32)
        state, kept = np.zeros((places.shape[1], h), np.float32), {}
        for t in steps:
            k = active[t]
            given, last = inputs[places[t, :k]], state[:k]
            inner = last @ weights
            gates = given[:, : 2 * h] + inner[:, : 2 * h]
            np.negative(gates, out=gates)
            np.exp(np.minimum(gates, 40, out=gates), out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            fresh = np.tanh(given[:, 2 * h :] + gates[:, :h] * inner[:, 2 * h :])
            new = fresh + gates[:, h:] * (last - fresh)
            if keep:
                kept[t] = (last.copy(), gates, fresh, inner[:, 2 * h :])
            state[:k] = new
            states[t, :k] = new
        return states, kept

    def logits(self, table: np.ndarray, places: np.ndarray, sizes: np.ndarray, keep: bool = False):
        """The logit of each window. ``table`` has the projected tokens; ``sizes`` fall."""
        h, length = self.hidden, len(places)
        active = (sizes[None, :] > np.arange(length)[:, None]).sum(axis=1)
        ahead, kept_ahead = self._pass(table[:, : 3 * h], places, active, self.p["forward"], range(length), keep)
        back, kept_back = self._pass(table[:, 3 * h :], places, active, self.p["backward"], range(length - 1, -1, -1), keep)
        score = ahead @ self.p["attend"][:h] + back @ self.p["attend"][h:]
        score[np.arange(length)[:, None] >= sizes[None, :]] = -np.inf
        share = np.exp(score - score.max(axis=0))
        share /= share.sum(axis=0)
        pooled = np.concatenate([np.einsum("tw,twh->wh", share, ahead), np.einsum("tw,twh->wh", share, back)], axis=1)
        out = pooled @ self.p["out"] + self.p["out_bias"][0]
        return (out, (active, ahead, back, kept_ahead, kept_back, share, pooled)) if keep else out

    def _back(self, grads: dict, name: str, d_states: np.ndarray, kept: dict, d_inputs: np.ndarray, active: np.ndarray, steps):
        h, weights = self.hidden, self.p[name]
        flow = np.zeros((d_states.shape[1], h), np.float32)
        d_weights = np.zeros_like(weights)
        for t in steps:
            k = active[t]
            last, gates, fresh, inner = kept[t]
            reset, update = gates[:, :h], gates[:, h:]
            d = flow[:k] + d_states[t, :k]
            d_fresh = d * (1 - update) * (1 - fresh * fresh)
            d_update = d * (last - fresh) * update * (1 - update)
            d_reset = d_fresh * inner * reset * (1 - reset)
            d_inner = np.concatenate([d_reset, d_update, d_fresh * reset], axis=1)
            d_weights += last.T @ d_inner
            flow[:k] = d * update + d_inner @ weights.T
            d_inputs[t, :k, : 2 * h] = d_inner[:, : 2 * h]
            d_inputs[t, :k, 2 * h :] = d_fresh
        grads[name] = d_weights

    def gradients(self, tokens: list[str], places: np.ndarray, sizes: np.ndarray, loss_slope) -> tuple[dict, np.ndarray]:
        """Gradients of all parameters; ``loss_slope`` maps the logits of the windows to their slopes."""
        h = self.hidden
        x, (words, groups) = self.embed(tokens)
        table = self.project(x)
        out, (active, ahead, back, kept_ahead, kept_back, share, pooled) = self.logits(table, places, sizes, keep=True)
        slope = loss_slope(out).astype(np.float32)
        grads = {"out": pooled.T @ slope, "out_bias": slope.sum(keepdims=True)}
        d_pooled = slope[:, None] * self.p["out"]
        d_share = np.einsum("wh,twh->tw", d_pooled[:, :h], ahead) + np.einsum("wh,twh->tw", d_pooled[:, h:], back)
        d_score = share * (d_share - (share * d_share).sum(axis=0))
        grads["attend"] = np.concatenate([np.einsum("tw,twh->h", d_score, ahead), np.einsum("tw,twh->h", d_score, back)])
        d_ahead = share[:, :, None] * d_pooled[None, :, :h] + d_score[:, :, None] * self.p["attend"][:h]
        d_back = share[:, :, None] * d_pooled[None, :, h:] + d_score[:, :, None] * self.p["attend"][h:]
        length = len(places)
        d_inputs = np.zeros((*places.shape, 6 * h), np.float32)
        self._back(grads, "forward", d_ahead, kept_ahead, d_inputs[:, :, : 3 * h], active, range(length - 1, -1, -1))
        self._back(grads, "backward", d_back, kept_back, d_inputs[:, :, 3 * h :], active, range(length))
        # Every token occurs, so the sums over equal places are one row for each token.
        order = np.argsort(places, axis=None, kind="stable")
        ordered = places.ravel()[order]
        d_table = np.add.reduceat(d_inputs.reshape(-1, 6 * h)[order], np.flatnonzero(np.diff(ordered, prepend=-1)), axis=0)
        grads["in"], grads["in_bias"] = x.T @ d_table, d_table.sum(axis=0)
        d_x, width = d_table @ self.p["in"].T, self.p["words"].shape[1]
        grads["words"], grads["grams"] = np.zeros_like(self.p["words"]), np.zeros_like(self.p["grams"])
        np.add.at(grads["words"], words, d_x[:, :width])
        for mine, grams in groups:
            each = np.repeat(d_x[mine, width:] / grams.shape[1], grams.shape[1], axis=0)
            np.add.at(grads["grams"], grams.ravel(), each)
        return grads, out


def arrange(starts: list[tuple[int, int]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows as (begin, length) in one run of tokens: places (T, W) of the longest first, lengths, order."""
    begin, lengths = (np.array(x, np.int64) for x in zip(*starts))
    order = np.argsort(-lengths, kind="stable")
    begin, lengths = begin[order], lengths[order]
    steps = np.arange(min(size, int(lengths[0])))[:, None]
    return np.where(steps < lengths, begin + steps, begin), lengths, order


class Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, params: dict, grads: dict) -> None:
        self.t += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            m = self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * g
            v = self.v[k] = 0.999 * self.v.get(k, 0) + 0.001 * g * g
            params[k] -= scale * m / (np.sqrt(v) + 1e-8)


def train(texts: list[str], labels: list[int], size: int, steps: int = 200, batch: int = 48, rate: float = 0.01, seed: int = 7) -> Network:
    """A network fitted to whole texts. All windows of a text with label 0 are taught 0; of one with
    label 1, the window with the largest logit is taught 1, as one window suffices to make a text toxic."""
    net, adam = Network(seed=seed), Adam(rate)
    lists = [tokens_of(t) for t in texts]
    usable = [i for i, x in enumerate(lists) if x]
    draw = np.random.default_rng(seed)
    done = 0
    while done < steps and usable:
        order = draw.permutation(usable)
        for at in range(0, len(order), batch):
            adam.rate = rate * min(1.0, 2 * (1 - done / steps))
            done += 1
            if done > steps:
                break
            mine = order[at : at + batch]
            names: dict[str, int] = {}
            run, spans, owner, base = [], [], [], 0
            for d, i in enumerate(mine):
                run += [names.setdefault(w, len(names)) for w in lists[i]]
                for s in windows_of(len(lists[i]), size, size):
                    spans.append((base + s, min(size, len(lists[i]) - s)))
                    owner.append(d)
                base += len(lists[i])
            where, lengths, window_order = arrange(spans, size)
            places = np.array(run, np.int64)[where]
            doc = np.array(owner)[window_order]
            target = np.array([labels[i] for i in mine], np.float32)

            def slope(out: np.ndarray) -> np.ndarray:
                top = np.full(len(mine), -np.inf, np.float32)
                np.maximum.at(top, doc, out)
                toxic = target[doc] == 1
                count = np.bincount(doc, minlength=len(mine))[doc]
                weight = np.where(toxic, (out == top[doc]).astype(np.float32), 0.5 / np.sqrt(count) + 0.5 * (out == top[doc]))
                return (sigmoid(out) - target[doc]) * weight / len(mine)

            grads, _ = net.gradients(list(names), places, lengths, slope)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            if norm > 1:
                grads = {k: g / norm for k, g in grads.items()}
            adam.step(net.p, grads)
    return net


class Scorer:
    """The largest logit over all overlapping windows of each text; token projections are remembered."""

    def __init__(self, net: Network, size: int, stride: int, at_once: int = 1024):
        self.net, self.size, self.stride, self.at_once = net, size, stride, at_once
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, 6 * self.net.hidden), np.float32)

    def _rows(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        new = [t for t in dict.fromkeys(tokens) if t not in known]
        if len(known) + len(new) > KNOWN_TOKENS:
            self._forget()
            known, new = self.known, list(dict.fromkeys(tokens))
        if new:
            need = len(known) + len(new)
            if need > len(self.table):
                grown = np.zeros((max(need, 2 * len(self.table)), self.table.shape[1]), np.float32)
                grown[: len(self.table)] = self.table
                self.table = grown
            for at in range(0, len(new), 20_000):
                part = new[at : at + 20_000]
                self.table[len(known) : len(known) + len(part)] = self.net.project(self.net.embed(part)[0])
                known.update(zip(part, range(len(known), len(known) + len(part))))
        return np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))

    def score(self, texts: list[str]) -> np.ndarray:
        """The logit of each text; NaN for one without words."""
        lists = [tokens_of(t) for t in texts]
        run = self._rows([w for x in lists for w in x])
        spans, owner, base = [], [], 0
        for d, x in enumerate(lists):
            n = len(x)
            for s in windows_of(n, self.size, self.stride):
                spans.append((base + s, min(self.size, n - s)))
                owner.append(d)
            base += n
        top = np.full(len(texts), -np.inf, np.float32)
        if spans:
            order = sorted(range(len(spans)), key=lambda i: -spans[i][1])
            for at in range(0, len(order), self.at_once):
                mine = order[at : at + self.at_once]
                where, lengths, inner = arrange([spans[i] for i in mine], self.size)
                logits = self.net.logits(self.table, run[where], lengths)
                np.maximum.at(top, np.array([owner[i] for i in mine])[inner], logits)
        top[np.isneginf(top)] = np.nan
        return top
