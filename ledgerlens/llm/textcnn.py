"""A convolutional text classifier in numpy: hashed word embeddings, several filter widths, max pooling."""

from __future__ import annotations

import string
import zlib
from dataclasses import dataclass, field

import numpy as np

#: Signs that are cut off a word's ends.
EDGE = string.punctuation + "¡¿«»"


def words_of(text: str) -> list[str]:
    """Words in lower case without signs at their ends; a word of nothing but signs stays as it is."""
    return [w.strip(EDGE) or w for w in text.lower().split()]


@dataclass
class TextCNN:
    """score = sigmoid(w . max over positions of relu(filters) + b). A word's vector is the sum of the vectors of its
    hash and of the hashes of its first letters, so that inflected and invented forms share what they begin with."""

    buckets: int = 1 << 15
    dim: int = 12
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 10
    seed: int = 7
    p: dict = field(default_factory=dict)

    #: Lengths of the beginnings of a word that are hashed besides the word.
    HEADS = (4, 6, 8, 10)

    def units(self, word: str) -> list[int]:
        raw = [word, *("^" + word[:k] for k in self.HEADS if len(word) > k)]
        return [zlib.crc32(r.encode()) % self.buckets for r in raw]

    # -- training ---------------------------------------------------------------------------------------------------

    def _start(self, rng: np.random.Generator) -> None:
        self.p = {"E": rng.normal(0, 0.1, (self.buckets, self.dim)).astype(np.float32), "b": np.zeros(1, np.float32), "w": rng.normal(0, 0.3, self.filters * len(self.widths)).astype(np.float32)}
        for k in self.widths:
            self.p[f"W{k}"] = rng.normal(0, (2 / (k * self.dim)) ** 0.5, (k * self.dim, self.filters)).astype(np.float32)
            self.p[f"c{k}"] = np.full(self.filters, -0.05, np.float32)

    def _pooled(self, vec: np.ndarray, starts: np.ndarray, where: bool):
        """Largest activation per document and filter, with its position. Documents end in max(widths) - 1 zero rows; a window
        begins inside its document, as one that begins in these rows would reach into the next."""
        tops, at = [], []
        gap = max(self.widths) - 1
        n = len(vec) - gap
        ends = np.append(starts[1:] - gap, n)
        sides = np.stack((starts, ends), 1).ravel()[:-1]  # every other stretch is a document
        for k in self.widths:
            W = self.p[f"W{k}"].reshape(k, self.dim, self.filters)
            act = vec[:n] @ W[0]
            for j in range(1, k):
                act += vec[j : j + n] @ W[j]
            tops.append(np.maximum.reduceat(act, sides, axis=0)[::2] + self.p[f"c{k}"])
            if where:
                at.append(np.stack([act[s:e].argmax(0) + s for s, e in zip(starts, ends)]))
        return np.concatenate(tops, 1), at

    def fit(self, docs: list[list[str]], labels: np.ndarray, epochs: int = 10, batch: int = 48, rate: float = 0.02, decay: float = 2e-5, drop: float = 0.3, steps: int = 600, rare: int = 2) -> TextCNN:
        """Adam on the weighted logistic loss; whole words are dropped at random so that no single one carries a class.
        A small sample is gone through more often, for `steps` updates at least."""
        epochs = max(epochs, -(-steps * batch // max(1, len(docs))))
        rng = np.random.default_rng(self.seed)
        self._start(rng)
        names: dict[str, int] = {}
        ids = [np.fromiter((names.setdefault(w, len(names)) for w in d), np.int64, len(d)) for d in docs]
        most = 1 + len(self.HEADS)
        unit = np.full((len(names) + 1, most), self.buckets, np.int64)  # the last bucket is no word
        for w, i in names.items():
            u = self.units(w)
            unit[i, : len(u)] = u
        # buckets of words in fewer documents than `rare` tell documents, not classes, apart: they stay zero, as unseen ones do
        held = np.zeros(self.buckets + 1, np.int64)
        for i in ids:
            held[np.unique(unit[i])] += 1
        known = held[: self.buckets] >= rare
        self.p["E"] = np.vstack([self.p["E"] * known[:, None], np.zeros((1, self.dim), np.float32)])
        known = np.append(known, False)
        E, gap = self.p["E"], np.full(max(self.widths) - 1, len(names))
        ones = max(1.0, labels.sum())
        weight = np.where(labels == 1, (len(labels) / (2 * ones)) ** 0.5, 1.0)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(docs))
            pace = rate * (1 - epoch / epochs) + rate * 0.05
            for lo in range(0, len(order), batch):
                take = order[lo : lo + batch]
                parts = [np.concatenate((np.where(rng.random(len(ids[i])) < drop, len(names), ids[i]) if len(ids[i]) else gap[:1], gap)) for i in take]
                flat = np.concatenate(parts)
                starts = np.cumsum([0, *map(len, parts[:-1])])
                used, inv = np.unique(flat, return_inverse=True)
                vec = E[unit[used]].sum(1)[inv]
                top, at = self._pooled(vec, starts, True)
                hidden = np.maximum(top, 0)
                z = hidden @ self.p["w"] + self.p["b"]
                err = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[take]) * weight[take] / len(take)).astype(np.float32)
                g = {"w": hidden.T @ err + 1e-4 * self.p["w"], "b": np.array([err.sum()], np.float32)}
                back = (err[:, None] * self.p["w"]) * (top > 0)
                touched, grads = [], []
                for n, k in enumerate(self.widths):
                    d, pos = back[:, n * self.filters : (n + 1) * self.filters], at[n]
                    W = self.p[f"W{k}"].reshape(k, self.dim, self.filters)
                    gW = np.empty_like(W)
                    for j in range(k):
                        x = vec[pos + j]  # documents x filters x dim
                        gW[j] = np.einsum("df,dfe->ef", d, x)
                        touched.append((pos + j).ravel())
                        grads.append((d[:, :, None] * W[j].T[None]).reshape(-1, self.dim))
                    g[f"W{k}"], g[f"c{k}"] = gW.reshape(k * self.dim, self.filters) + 1e-4 * self.p[f"W{k}"], d.sum(0)
                u = unit[flat[np.concatenate(touched)]]
                ge = np.repeat(np.concatenate(grads)[:, None], most, 1).reshape(-1, self.dim)
                live, back_to = np.unique(u.ravel(), return_inverse=True)
                sums = np.zeros((len(live), self.dim), np.float32)
                np.add.at(sums, back_to, ge)
                step += 1
                fix = pace * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
                for k, x in g.items():
                    m[k] += 0.1 * (x - m[k])
                    v[k] += 0.001 * (x * x - v[k])
                    self.p[k] -= fix * m[k] / (np.sqrt(v[k]) + 1e-8)
                keep = live[known[live]]  # vectors move only where a gradient reached them
                x = sums[known[live]]
                m["E"][keep] += 0.1 * (x - m["E"][keep])
                v["E"][keep] += 0.001 * (x * x - v["E"][keep])
                E[keep] -= fix * m["E"][keep] / (np.sqrt(v["E"][keep]) + 1e-8) + pace * decay * E[keep]
        self.p["E"] = E.astype(np.float32)
        return self


@dataclass
class Ensemble:
    """Networks that hash words alike, scored together: each word is looked up once, logits are averaged."""

    nets: list[TextCNN]
    rows: dict = field(default_factory=dict, repr=False)
    tables: list | None = field(default=None, repr=False)

    #: Words that a scoring process keeps vectors of; beyond it starts anew.
    KEEP = 150_000

    def __getstate__(self):
        return {"nets": self.nets, "rows": {}, "tables": None}

    def logits(self, texts: list[str], most: int = 100_000) -> np.ndarray:
        """One logit per text, over all its words; at most about `most` words (or one text) are in memory at a time."""
        out, held, n = [np.empty(0)], [], 0
        for t in texts:
            words = words_of(t) or [""]
            held.append(words)
            n += len(words)
            if n >= most:
                out.append(self._score(held))
                held, n = [], 0
        if held:
            out.append(self._score(held))
        return np.concatenate(out)

    def _learn(self, words: set[str]) -> None:
        new = list(words - self.rows.keys())
        if not new:
            return
        most = 1 + len(TextCNN.HEADS)
        unit = np.full((len(new), most), self.nets[0].buckets, np.int64)
        for i, w in enumerate(new):
            u = self.nets[0].units(w)
            unit[i, : len(u)] = u
        self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
        for k, net in enumerate(self.nets):
            table, size = self.tables[k], len(self.rows)
            if size > len(table):  # by a quarter at least, so that growing costs little
                table = self.tables[k] = np.vstack([table, np.zeros((max(size, 5 * len(table) // 4) - len(table), net.dim), np.float32)])
            table[size - len(new) : size] = net.p["E"][unit].sum(1)

    def _score(self, docs: list[list[str]]) -> np.ndarray:
        if self.tables is None or len(self.rows) > self.KEEP:
            self.rows, self.tables = {"": 0}, [np.zeros((1, n.dim), np.float32) for n in self.nets]
        self._learn({w for d in docs for w in d})
        gap = [0] * (max(self.nets[0].widths) - 1)
        flat: list[int] = []
        starts = []
        for d in docs:
            starts.append(len(flat))
            flat.extend(map(self.rows.__getitem__, d))
            flat.extend(gap)
        ids, starts = np.array(flat), np.array(starts)
        out, at = [], 0
        while at < len(starts):  # blocks of documents, so that activations stay in the processor's cache
            end = max(at + 1, int(np.searchsorted(starts, starts[at] + 8_000)))
            part = ids[starts[at] : starts[end] if end < len(starts) else len(ids)]
            total = np.zeros(end - at)
            for net, table in zip(self.nets, self.tables):
                top, _ = net._pooled(table[part], starts[at:end] - starts[at], False)
                total += np.maximum(top, 0) @ net.p["w"] + net.p["b"]
            out.append(total / len(self.nets))
            at = end
        return np.concatenate(out)
