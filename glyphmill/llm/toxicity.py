"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

The bag is a run of ``WIDTH`` words, since a few words decide in a long text: a text is as toxic as its worst run.  Labels
stand on texts, so training begins with all runs of a toxic text as toxic, and then keeps its worst ones (multiple-instance
learning).  Labels are noisy, so grams get embeddings of their own only if they prefer toxic texts beyond chance; the
embedding of all others is zero.  Misspelt words share character grams with those met in training.  The score rises with the worst run's
margin as label 1 does among labelled texts held aside, so it is a calibrated probability.

``fit`` takes at most ``per_class`` labelled documents of each class, by the hash of their ids (a documented bound), as
whole texts: every run of a clean text teaches, and those of a long text weigh as much together as ``clean_runs``.  Scores use
every word of every text.  Null, empty and wordless texts have the score of no evidence.  Without both classes among the labels
every score is the share of label 1, or 0.  Repeated rows score alike, rows without an id are scored and never learnt from, an
empty table gives no rows, and columns other than doc_id, text and toxic are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import subword
from glyphmill.llm.common import Grams, held_out, small_batches, table, texts_of
from glyphmill.llm.simhash import fingerprint

WIDTH = 2
#: For an embedding of its own a gram must stand in so many toxic texts, prefer them by so much chi-square, and be so many times as common there.
SUPPORT, PREFERENCE, TIMES = 6, 25.0, 4.0


@dataclass
class Model:
    grams: Grams
    margin: np.ndarray  # of each bucket: logit of toxic less that of clean
    knots: np.ndarray  # margins, ascending
    shares: np.ndarray  # calibrated scores at the knots, ascending
    none: float  # margin of a text without words

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """The worst run's margin of each whole text."""
        out = np.full(len(texts), self.none)
        for a, b in subword.chunks(texts):
            data, ends = self.grams.lay_out([t.lower() for t in texts[a:b]])
            sums, n = subword.word_sums(self.grams, data, self.margin)
            blanks = np.append(0, np.cumsum(data == 32))[ends]
            for i in range(b - a):
                first, last = blanks[i], blanks[i + 1] - 1  # the last blank of a text begins no word
                means = subword.window_means(sums[first:last], n[first:last], WIDTH)
                if len(means) and n[first:last].any():
                    out[a + i] = means.max()
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The calibrated share, with a hundredth of a logistic curve, so that larger margins always score higher."""
        x = self.margins(texts)
        if len(self.knots) == 1:
            return np.full(len(x), self.shares[0])
        return 0.99 * np.interp(x, self.knots, self.shares) + 0.01 / (1 + np.exp(-np.clip(x / 8, -30, 30)))


def sample(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[list, float]:
    """About per_class labelled rows (text, toxic) of each class, never over four times that, and the share of label 1."""
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, F.lit(per_class / max(counts.get(1, 0), 1))).otherwise(F.lit(per_class / max(counts.get(0, 0), 1)))
    ids = known.where(F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 20)) < share * (1 << 20)).limit(4 * per_class)
    rows = docs.join(F.broadcast(ids), "doc_id").where("text is not null").select("text", "toxic").limit(4 * per_class).collect()
    return rows, counts.get(1, 0) / max(sum(counts.values()), 1)


def _isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted shares of label 1 that rise with x: neighbours are pooled while they fall."""
    blocks: list[list[float]] = []  # sum of w y, sum of w, least and most x
    for i in np.argsort(x, kind="stable"):
        blocks.append([w[i] * y[i], w[i], x[i], x[i]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0] + b[0], blocks[-1][1] + b[1], blocks[-1][2], b[3]]
    knots = np.array([v for b in blocks for v in (b[2], b[3])])
    return knots, np.array([v for b in blocks for v in [b[0] / b[1]] * 2])


def _apart(rows: list[tuple[str, int]], tau: int = 6) -> list[tuple[str, int]]:
    """Rows without near copies of earlier ones: copies share a label, right or wrong, and would make it look supported."""
    prints = np.array([fingerprint(t.encode()) for t, _ in rows], dtype=np.uint64)
    kept: list[int] = []
    seen = np.empty(len(rows), dtype=np.uint64)
    for i, p in enumerate(prints):
        if not (np.bitwise_count(seen[: len(kept)] ^ p) <= tau).any():
            seen[len(kept)] = p
            kept.append(i)
    return [rows[i] for i in kept]


def _telling(grams: Grams, texts: list[tuple[bytes, int]]) -> np.ndarray:
    """Which buckets stand in more toxic texts than chance explains."""
    df, n = np.zeros((2, 1 << grams.bits)), np.zeros(2)
    for t, y in texts:
        df[y][np.unique(subword.grams_of(grams, t))] += 1
        n[y] += 1
    total = n.sum()
    a, b = df[1], df[0]
    chi = total * (a * (n[0] - b) - b * (n[1] - a)) ** 2 / np.maximum((a + b) * (total - a - b) * n[0] * n[1], 1)
    prefers = (a >= min(SUPPORT, max(2, n[1] // 8))) & (a * n[0] >= TIMES * (b + 1) * n[1])
    bar = min(PREFERENCE, float(chi[prefers].max()) / 2) if prefers.any() else PREFERENCE  # few labels: the best half
    return prefers & (chi >= bar)


def _by_word(grams: Grams, text: bytes, own: np.ndarray, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's grams, word after word, and where each word's begin (one more: where the last ends); buckets without an embedding of their own are the shared one.

    A run of words has the grams of its words, as none reaches over a blank.
    """
    data, _ = grams.lay_out([text])
    blanks = np.flatnonzero(data == 32)
    ids, words = [], []
    for _, h, ok in grams.hashed(data):
        at = np.flatnonzero(ok)
        ids.append(np.where(own[h[at]], h[at], np.int32(shared)))
        words.append(np.searchsorted(blanks, at, side="right") - 1)
    if not ids:
        return np.empty(0, dtype=np.int32), np.zeros(1, dtype=np.int64)
    words, ids = np.concatenate(words), np.concatenate(ids)
    return ids[np.argsort(words, kind="stable")], np.append(0, np.cumsum(np.bincount(words, minlength=max(len(blanks) - 1, 1))))


def train(rows: list[tuple[str, int]], share: float, bits: int = 20, clean_runs: int = 30, seed: int = 5) -> Model:
    """A model of rows (text, toxic); share: how common label 1 is, to which scores are calibrated."""
    grams = Grams((3, 4, 5), bits)
    rows = _apart(sorted(rows))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    kinds = {t for _, t in rows}
    if kinds != {0, 1}:
        p = min(max(share, 1e-6), 1 - 1e-6)
        return Model(grams, np.zeros(1 << bits, np.float32), np.zeros(1), np.array([p]), 0.0)
    texts = [(rows[i][0].encode().lower(), rows[i][1]) for i in order]
    cut = max(1, len(texts) // 5) if len(texts) >= 50 else 0
    aside, fitting = texts[:cut] or texts, texts[cut:]
    own = _telling(grams, fitting)
    shared = 1 << bits  # the bucket of all other grams, whose embedding is zero

    toxic, clean, heed = [], [], []
    for t, y in fitting:
        n = len(t.split())
        ids, begin = _by_word(grams, t, own, shared)
        told = np.append(0, np.cumsum(ids != shared))[begin]  # telling grams before each word
        if y and n:
            toxic.append([ids[begin[at] : begin[min(at + WIDTH, n)]] for at in range(max(1, n - WIDTH + 1)) if told[min(at + WIDTH, n)] > told[at]])
        elif n:
            # every place of a clean text begins a run; runs without a telling gram are alike, so a few stand for all of them
            ends = np.minimum(np.arange(n) + 1 + np.arange(n) % WIDTH, n)
            met, share_of = np.flatnonzero(told[ends] > told[:n]), min(1.0, clean_runs / n)
            plain = share_of * (n - len(met))
            alike = [np.array([shared], dtype=np.int32)] * int(np.ceil(plain))
            clean += [*(ids[begin[at] : begin[ends[at]]] for at in met), *alike]
            heed += [share_of] * len(met) + [plain / max(len(alike), 1)] * len(alike)
    margin = None
    for step in range(3):
        runs: list[np.ndarray] = []
        for bags in toxic:
            # at first all runs with a telling gram; then the worst of each text
            if margin is None:
                runs += bags
            elif bags:
                worst = subword.bag_logits(subword.Bags.of(bags), margin[:, None], np.zeros(1))[:, 0]
                runs += [bags[i] for i in np.argsort(-worst, kind="stable")[:4]]
        if not runs:
            break
        bags = subword.Bags.of([*runs, *clean])
        y = np.append(np.ones(len(runs), dtype=int), np.zeros(len(clean), dtype=int))
        weight = np.append(np.full(len(runs), min(8.0, (sum(heed) / len(runs)) ** 0.5)), heed)
        weights, bias = subword.train(bags, y, 2, shared + 1, dim=8, epochs=3, rate=0.8, weight=weight, seed=seed + step, still=shared)
        margin = weights[:, 1] - weights[:, 0]
    if margin is None:
        margin = np.zeros(shared + 1, dtype=np.float32)
    model = Model(grams, np.where(own, margin[:-1], margin[-1]).astype(np.float32), np.zeros(1), np.zeros(1), 0.0)
    # clean texts taught by a few runs each, so their worst runs still say how often clean texts go astray
    checked = [*aside, *((t, y) for t, y in fitting if not y)] if cut else aside
    x = model.margins([t for t, _ in checked])
    y = np.array([t for _, t in checked], dtype=float)
    model.none = float(np.median(x[y == 0])) if (y == 0).any() else 0.0
    w = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    model.knots, model.shares = _isotonic(x, y, w)
    return model


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1200) -> Model:
    rows, share = sample(docs, labels, per_class)
    return train([(r.text, r.toxic) for r in rows], share)


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.scores(texts_of(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, score), a row for each row."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(_scorer(model), "doc_id long, score double")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
