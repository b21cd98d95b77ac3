"""Averaged hashed subword embeddings under a linear softmax, trained by stochastic gradient descent in numpy.

After training, embeddings and softmax fold into one table of bucket by class: a text's logits are the mean of its grams'
rows, plus the bias.  Scoring is one gather and one segmented sum over bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from glyphmill.llm.common import Grams


@dataclass
class Bags:
    """ids[ends[i-1]:ends[i]] are the gram buckets of bag i, repeats included."""

    ids: np.ndarray
    ends: np.ndarray

    def __len__(self) -> int:
        return len(self.ends)

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of the bags, and each id's place in which."""
        begin = np.append(0, self.ends[:-1])[which]
        size = self.ends[which] - begin
        stop = np.cumsum(size)
        return self.ids[np.arange(stop[-1] if len(stop) else 0) + np.repeat(begin - stop + size, size)], np.repeat(np.arange(len(which)), size)

    @staticmethod
    def of(parts: list[np.ndarray]) -> Bags:
        return Bags(np.concatenate(parts) if parts else np.empty(0, np.int32), np.cumsum([len(p) for p in parts], dtype=np.int64))


def grams_of(grams: Grams, text: bytes) -> np.ndarray:
    data, _ = grams.lay_out([text])
    found = [h[ok] for _, h, ok in grams.hashed(data)]
    return np.concatenate(found) if found else np.empty(0, np.int32)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(bags: Bags, y: np.ndarray, classes: int, buckets: int, dim: int = 12, epochs: int = 6, rate: float = 0.5, batch: int = 32, seed: int = 7, weight: np.ndarray | None = None, still: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The folded table (buckets, classes) and the bias.  Embeddings and softmax learn together; the rate falls to zero.  still: a bucket that stays at zero."""
    rng = np.random.default_rng(seed)
    emb = ((rng.random((buckets, dim)) - 0.5) * (2 / dim)).astype(np.float32)
    if still is not None:
        emb[still] = 0
    out = np.zeros((dim, classes), dtype=np.float32)
    bias = np.zeros(classes, dtype=np.float32)
    target = np.eye(classes, dtype=np.float32)[y]
    weight = np.ones(len(bags), dtype=np.float32) if weight is None else weight.astype(np.float32)
    steps, done = max(1, epochs * len(bags)), 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            which = order[at : at + batch]
            ids, owner = bags.take(which)
            n = np.maximum(np.bincount(owner, minlength=len(which)), 1).astype(np.float32)
            starts = np.searchsorted(owner, np.arange(len(which)))
            mean = np.zeros((len(which), dim), dtype=np.float32)
            some = np.flatnonzero(np.bincount(owner, minlength=len(which)))
            if len(ids):
                mean[some] = np.add.reduceat(emb[ids], starts[some], axis=0) / n[some, None]
            wrong = (softmax(mean @ out + bias) - target[which]) * weight[which, None]
            lr = rate * (1 - done / steps)
            back = (wrong @ out.T) * (lr / n)[:, None]
            out -= lr / 4 * (mean.T @ wrong)
            bias -= lr / 16 * wrong.mean(axis=0)
            np.subtract.at(emb, ids, back[owner])
            if still is not None:
                emb[still] = 0
            done += len(which)
    return (emb @ out).astype(np.float32), bias


def bag_logits(bags: Bags, table: np.ndarray, bias: np.ndarray) -> np.ndarray:
    ids, owner = bags.take(np.arange(len(bags)))
    n = np.bincount(owner, minlength=len(bags))
    sums = np.stack([np.bincount(owner, weights=table[ids, c], minlength=len(bags)) for c in range(table.shape[1])], axis=1)
    return sums / np.maximum(n, 1)[:, None] + bias


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The factor of logits under which held-aside labels are likeliest."""
    factors = np.geomspace(0.05, 50, 60)
    loss = [-np.log(np.maximum(softmax(logits * f)[np.arange(len(y)), y], 1e-12)).mean() for f in factors]
    return float(factors[int(np.argmin(loss))])


#: Bytes of text that are hashed at once.
CHUNK = 1 << 20


def chunks(texts: list[bytes]):
    """Slices of texts of about CHUNK bytes; a longer text alone."""
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > CHUNK:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def text_logits(grams: Grams, texts: list[bytes], table: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Logits of whole texts; a text without a gram has those of the bias."""
    out = np.zeros((len(texts), table.shape[1]))
    padded = np.concatenate((table, np.zeros((1, table.shape[1]), dtype=table.dtype)))
    for a, b in chunks(texts):
        data, ends = grams.lay_out([t.lower() for t in texts[a:b]])
        sums, n = np.zeros((b - a, table.shape[1])), np.zeros(b - a)
        for _, h, ok in grams.hashed(data):
            rows = np.where(ok, h, len(table))
            starts = np.minimum(ends[:-1], len(rows) - 1)
            sums += np.add.reduceat(padded[rows], starts, axis=0)
            n += np.add.reduceat(ok, starts, dtype=np.int64)
        out[a:b] = sums / np.maximum(n, 1)[:, None]
    return out + bias


def windows(grams: Grams, text: bytes, table: np.ndarray, width: int) -> np.ndarray:
    """Mean of a one-column table over the grams of each run of width words; a shorter text is one window; none: empty."""
    data, _ = grams.lay_out([text])
    sums, n = word_sums(grams, data, table)
    return window_means(sums[:-1], n[:-1], width)


def word_sums(grams: Grams, data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each blank of the laid-out bytes: sum and number of the grams that begin there or within the word after it."""
    blanks = np.flatnonzero(data == 32)
    sums, n = np.zeros(len(blanks)), np.zeros(len(blanks))
    if not len(blanks):
        return sums, n
    padded = np.append(table, np.float32(0))
    for _, h, ok in grams.hashed(data):
        rows = np.full(len(data), len(table))  # no gram begins at the last bytes
        rows[: len(h)] = np.where(ok, h, len(table))
        sums += np.add.reduceat(padded[rows], blanks)
        n += np.add.reduceat(np.append(ok, np.zeros(len(data) - len(ok), dtype=bool)), blanks, dtype=np.int64)
    return sums, n


def window_means(sums: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    if not len(sums):
        return np.empty(0)
    w = min(width, len(sums))
    cs, cn = np.append(0, np.cumsum(sums)), np.append(0, np.cumsum(n))
    return (cs[w:] - cs[:-w]) / np.maximum(cn[w:] - cn[:-w], 1)
