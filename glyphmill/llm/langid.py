"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

``fit`` learns from about ``per_language`` labelled documents of every language (a documented bound; taken by the hash of their
ids), of fewer where there are so many languages that they would be more than ``most_rows`` together, but of eight at least; as whole
texts and as random runs of their words, so that short texts are met in training.  Beyond 200 languages the table of grams is smaller.
Other documents, ``aside_per_language`` of each, set the temperature of the softmax and the score below which a
prediction is rejected: that below which a share ``alpha`` of the right predictions among them lies, one half at most.

Null texts and texts without a letter (Unicode category L) are ``und`` with score 0 and are rejected.  Without a labelled
document all are.  Repeated rows are predicted alike, rows without an id like others, and an empty table gives no rows.  lang, source and doc_id are no inputs
of a prediction.  ``keep_known`` keeps all columns, whatever their names; ``predict`` adds lang_pred, score and rejected, and
refuses a table that has them already.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import subword
from glyphmill.llm.common import Grams, held_out, small_batches, table

UNDETERMINED = "und"
#: Texts and runs of a language that training meets at least, again if need be.
VISITS = 1250
#: Characters of Unicode category L, which \p{L} is.
LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    languages: list[str]
    grams: Grams
    table: np.ndarray
    bias: np.ndarray
    factor: float
    least: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is rejected, for each text."""
        letters = np.array([t is not None and LETTER.search(t) is not None for t in texts], dtype=bool)
        if not self.languages:
            letters[:] = False
        names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        own = np.flatnonzero(letters)
        if len(own):
            p = subword.softmax(self.factor * subword.text_logits(self.grams, [texts[i].encode() for i in own], self.table, self.bias))
            best = p.argmax(axis=1)
            for i, b in zip(own, best):
                names[i] = self.languages[b]
            scores[own] = p[np.arange(len(own)), best]
        return names, scores, ~letters | (scores < self.least)


def sample(docs: DataFrame, per_language: int, aside_per_language: int, most_rows: int) -> tuple[list, list]:
    """About per_language rows (text, lang) of each language and about aside_per_language others, never more than twice as many in all."""
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()
    if not counts:
        return [], []
    per_language, aside_per_language = (max(8, min(n, most_rows // len(counts))) for n in (per_language, aside_per_language))
    both = per_language + aside_per_language
    shares = docs.sparkSession.createDataFrame([(r.lang, per_language / r.n, both / r.n) for r in counts], "lang string, learnt double, seen double")
    place = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20)) / float(1 << 20)
    rows = known.join(F.broadcast(shares), "lang").where(place < F.col("seen")).select("text", "lang", (place < F.col("learnt")).alias("learnt")).limit(2 * both * len(counts)).collect()
    return [(r.text, r.lang) for r in rows if r.learnt], [(r.text, r.lang) for r in rows if not r.learnt]


def train(rows: list[tuple[str, str]], alpha: float = 0.001, bits: int = 16, seed: int = 11, aside: list[tuple[str, str]] | None = None) -> Model:
    """A model of rows (text, lang), calibrated on aside; without it on a tenth of 50 rows or more."""
    grams = Grams((2, 3, 4), bits)
    rows = sorted(rows)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    if aside is None:
        few = order[::10] if len(rows) >= 50 else []
        aside, order = [rows[i] for i in few], order if not len(few) else [i for k, i in enumerate(order) if k % 10]
    languages = sorted({rows[i][1] for i in order})
    checked = [(text, languages.index(lang)) for text, lang in aside if lang in languages]
    parts, y = [], []
    for i in order:
        text, lang = rows[i]
        data, label = text.encode().lower(), languages.index(lang)
        words = data.split()
        parts.append(subword.grams_of(grams, data))
        y.append(label)
        for size in (1, 3, 8, 20):
            if len(words) > size:
                at = int(rng.integers(0, len(words) - size + 1))
                parts.append(subword.grams_of(grams, b" ".join(words[at : at + size])))
                y.append(label)
    if not rows:
        return Model([], grams, np.zeros((1 << bits, 1), np.float32), np.zeros(1, np.float32), 1.0, 1.0)
    epochs = min(40, max(5, -(-VISITS * len(languages) // len(parts))))  # few texts of a language are met more often
    weights, bias = subword.train(subword.Bags.of(parts), np.array(y), len(languages), 1 << bits, epochs=epochs, seed=seed)
    if not checked:
        return Model(languages, grams, weights, bias, 1.0, 0.0)
    logits = subword.text_logits(grams, [text.encode() for text, _ in checked], weights, bias)
    truth = np.array([label for _, label in checked])
    factor = subword.temperature(logits, truth)
    p = subword.softmax(factor * logits)
    right = p.argmax(axis=1) == truth
    least = float(np.quantile(p.max(axis=1)[right], alpha)) if right.any() else 0.0
    return Model(languages, grams, weights, bias, factor, min(least, 0.5))


def fit(docs: DataFrame, per_language: int = 250, alpha: float = 0.001, aside_per_language: int = 300, most_rows: int = 50_000) -> Model:
    rows, aside = sample(docs, per_language, aside_per_language, most_rows)
    return train(rows, alpha, bits=16 if len({lang for _, lang in rows}) <= 200 else 14, aside=aside if rows else None)


def _predictor(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores, rejected = model.predict(b.column(b.schema.get_field_index("text")).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores), pa.array(rejected)], names=[*b.schema.names, "lang_pred", "score", "rejected"])

    return run


ADDED = ("lang_pred", "score", "rejected")


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs, with a column text -> the same rows and columns, lang_pred string, score double, rejected boolean."""
    if clash := sorted({c.lower() for c in docs.columns} & set(ADDED)):
        raise ValueError(f"columns there already: {', '.join(clash)}")
    small_batches(docs.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_predictor(model), f"{fields}, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, per_language: int = 250) -> DataFrame:
    """The rows of docs whose language is not rejected, with all columns, whatever their names."""
    own = docs.select(F.col("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return predict(own, fit(docs, per_language)).where("not rejected").select("row.*")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    scored = predict(docs.select("doc_id", "text"), fit(docs))
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "lang_pred", "score", "rejected")
