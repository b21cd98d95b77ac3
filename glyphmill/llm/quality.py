"""Quality rules: base statistics of whole texts, and a learned decision list of threshold conjunctions.

``statistics`` reads every word of every text once.  ``learn`` fits a decision list on labelled statistics by sequential
covering: a rule grows one threshold at a time by information gain on two thirds of the rows, is pruned on the rest, and
its rows are removed before the next; only rules that are right often enough on the pruning rows are kept.  The list becomes
one ordered Spark conditional expression (``verdict``): the first rule that holds rejects, otherwise the text is kept.

``learn`` sees at most ``most_rows`` labelled rows (a documented bound; taken by the hash of their ids).  Null and empty texts
have no words, so the base rule rejects them.  Repeated rows are judged alike.  Without both labels the list is empty.  Rows
without an id are judged like others and never learnt from; an empty table gives no rows; only doc_id, text and quality are read,
so other columns may have any name.  Very long texts are read whole, one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.common import cut, held_out, small_batches, table

#: Blanks, symbols.
BLANKS, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_marks"]
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """Words that stand in a 3-word window found twice or more; and the number of distinct words."""
    codes: dict[bytes, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), dtype=np.int64, count=len(words))
    k = len(codes)
    if len(words) < 4 or k == len(words):
        return 0, k
    if k < 1 << 21:
        key = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
    else:
        pair = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)[1]
        key = pair[:-1] * k + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    marked = np.zeros(len(words), dtype=bool)
    for d in range(3):
        marked[d : d + len(key)] |= twice
    return int(marked.sum()), k


def text_statistics(text: str | None) -> tuple[int, ...]:
    """COUNTS of a text; n_upper: upper-case letters, n_marks: exclamation marks."""
    text = text or ""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    repeats, distinct = repeated_words(words)
    chars = len(text) - sum(map(text.count, BLANKS))
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeats, len(lines), distinct, upper, text.count("!")


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = np.array([text_statistics(t) for t in b.column(1).to_pylist()], dtype=np.int64).reshape(-1, len(COUNTS))
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(rows[:, i]) for i in range(len(COUNTS)))], names=["doc_id", *COUNTS])


def statistics(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, COUNTS), a row for each row."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_statistics, SCHEMA)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: The measures that thresholds stand on, each a quotient of two counts (or a count).
MEASURES = {
    "symbol_share": ("n_symbols", "word_chars"),
    "upper_share": ("n_upper", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
    "word_length": ("word_chars", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
    "words": ("n_words", None),
}


def measure_column(name: str) -> Column:
    top, under = MEASURES[name]
    return F.col(top) / F.greatest(F.col(under), F.lit(1)) if under else F.col(top).cast("double")


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.measure] > self.threshold if self.above else x[self.measure] <= self.threshold

    def column(self) -> Column:
        c = measure_column(self.measure)
        return c > self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    right: int
    covered: int

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([c.holds(x) for c in self.conditions])

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions)) + f"  [{self.right} of {self.covered}]"


def _best_condition(x: dict[str, np.ndarray], bad: np.ndarray, inside: np.ndarray, steps: int) -> Condition | None:
    """The threshold of most FOIL gain, midway between neighbours, among quantiles of the rows and of the values that the rule covers so far."""
    p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
    base, best = np.log2((p0 + 1) / (p0 + n0 + 2)), (1e-9, None)
    for name, values in x.items():
        own = np.unique(values[inside])
        for at in np.unique(np.concatenate((np.searchsorted(own, np.quantile(values[inside], np.linspace(0, 1, steps + 1)), "right") - 1, np.linspace(0, len(own) - 1, steps).astype(int)))):
            if at + 1 >= len(own):
                continue
            for above in (True, False):
                c = Condition(name, above, float((own[at] + own[at + 1]) / 2))
                got = inside & c.holds(x)
                p, n = int((got & bad).sum()), int((got & ~bad).sum())
                gain = p * (np.log2((p + 1) / (p + n + 2)) - base)
                if p and gain > best[0]:
                    best = (gain, c)
    return best[1]


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.75, least: int = 6, most_rules: int = 12, steps: int = 40, seed: int = 3) -> list[Rule]:
    """The decision list; bad: rows labelled 0.  A rule must be right on at least `precision` of the rows it covers, in the growing and the pruning part alike."""
    rng = np.random.default_rng(seed)
    left = np.ones(len(bad), dtype=bool)
    rules: list[Rule] = []
    while len(rules) < most_rules and (left & bad).sum() >= least:
        grow = rng.random(len(bad)) < 2 / 3
        inside, conditions = left & grow, []
        while len(conditions) < 4 and (inside & ~bad).any():
            c = _best_condition(x, bad, inside, steps)
            if c is None:
                break
            conditions.append(c)
            inside = inside & c.holds(x)
        check = left & ~grow

        def worth(cs: list[Condition]) -> float:
            got = check & np.logical_and.reduce([c.holds(x) for c in cs])
            p, n = int((got & bad).sum()), int((got & ~bad).sum())
            return (p - n) / max(p + n, 1)

        while len(conditions) > 1 and worth(conditions[:-1]) >= worth(conditions):
            conditions = conditions[:-1]
        if not conditions:
            break
        held = np.logical_and.reduce([c.holds(x) for c in conditions])
        shares = [((left & part & held & bad).sum(), (left & part & held).sum()) for part in (grow, ~grow)]
        if any(p < precision * n or n < 2 for p, n in shares) or sum(n for _, n in shares) < least:
            break
        rules.append(Rule(tuple(conditions), int(sum(p for p, _ in shares)), int(sum(n for _, n in shares))))
        left &= ~held
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True: kept."""
    out = None
    for r in rules:
        out = F.when(r.column(), F.lit(False)) if out is None else out.when(r.column(), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(stats: DataFrame, labels: DataFrame, most_rows: int = 6000) -> list[Rule]:
    """A decision list from stats and labels (doc_id, quality); rows that the base rule rejects teach nothing."""
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = known.count()
    ids = known.where(F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 20)) < F.lit(min(1.0, most_rows / max(n, 1)) * (1 << 20))).limit(2 * most_rows)
    rows = stats.join(F.broadcast(ids), "doc_id").where(~base_failed()).select("quality", *(measure_column(m).alias(m) for m in MEASURES)).limit(2 * most_rows).toPandas()
    if rows["quality"].nunique() < 2:
        return []
    rows = rows.sort_values(list(rows.columns))
    return learn({m: rows[m].to_numpy(dtype=float) for m in MEASURES}, rows["quality"].to_numpy() == 0)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = cut(statistics(table(spark, sf_dir, "documents", "doc_id", "text")))
    rules = fit(stats, table(spark, sf_dir, "labels", "doc_id", "quality"))
    kept = F.when(base_failed(), F.lit(False)).otherwise(verdict(rules))
    return stats.select("doc_id", *COUNTS[:5], base_failed().alias("base_failed"), kept.alias("kept"))
