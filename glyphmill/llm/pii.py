"""Personal data by bootstrapped contextual extraction.

1. ``scan`` reads each whole text once: base spans (email, ip, card, phone), and every identifier-like token (it holds an @,
   or three digits at least) with the lexical patterns it stands in.  A pattern is a kind of token and the words about it, the
   token's slot left open: two words before, one before, one on either side, two after.  Line ends are words of their own, and words
   with digits or an @ are one word, "#", so patterns carry over to other texts.
2. Instances are distinct values of tokens; those that a base span covers somewhere are the seeds.  Patterns and instances
   form a graph of pre-aggregated edges, which Spark scores in rounds.  A pattern's score is the lower 95 % bound (Wilson)
   of the share of known values among its distinct values; it counts from ``support`` known values in two texts on.
   An instance's score is the chance that not all of its patterns err.  Instances of a score of ``confidence`` at least are
   known in the next round, where they support patterns that seeds never met.  Rounds end when nothing new is found.
3. Every token whose value became known so is added as a span of kind ``id``; base spans stay as they are.

Null and empty texts have no spans.  Repeated rows find the same, and copies of a text support a pattern once, as their
values are the same.  Added spans never overlap base ones.  Without seeds, or in an empty table, nothing is added.  Only
doc_id and text are read, so other columns may have any name.  Rows whose doc_id is null are scanned like others.  Spans are
in code points, end exclusive.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.common import small_batches, table, written

#: The kinds in order, and their patterns; an address grows from its @, so long runs are read once.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
BLANKS = " \t\n\v\f\r"
TOKEN = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")
EDGES = ".,;:!?\"'()[]{}<>#*$%&|"


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: the run of local characters that ends at an @ begins a match if a domain follows."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(end, at + 1))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in the order of kinds, then of starts."""
    out = [(0, *s) for s in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    if text.count(".") >= 3:
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m[0])) <= 15]
    return out


WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Words of more characters stand in patterns by their hash.
LONG = 64
#: What stands for the ends of a line and for words with digits or an @.
FIRST, LAST, NUMBER = "^", "$", "#"


def kind_of(token: str) -> str:
    """at: holds an @; digits: no letter; mixed."""
    return "at" if "@" in token else "mixed" if any(map(str.isalpha, token)) else "digits"


def word_of(raw: str) -> str:
    """A word as patterns hold it."""
    w = raw.strip(EDGES).lower() or raw
    if DIGIT.search(w) or "@" in w:
        return NUMBER
    return w if len(w) <= LONG else f"~{xxhash.xxh64_hexdigest(w.encode())}"


def patterns_of(kind: str, l2: str, l1: str, r1: str, r2: str) -> list[str]:
    """The patterns of an occurrence between two words on either side that hold a word of the language; _ is the open slot."""
    held = {(l2, l1): f"{l2} {l1} _", (l1,): f"{l1} _", (l1, r1): f"{l1} _ {r1}", (r1, r2): f"_ {r1} {r2}"}
    return list(dict.fromkeys(f"{kind}: {p}" for words, p in held.items() if any(w not in (FIRST, LAST, NUMBER) for w in words)))


def _tokens(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Identifier-like tokens with their patterns.  seed: a base span; those that touch count as one.  Words that a seed stands in are no tokens
    besides, and contexts lie about whole words, so each word of a text is looked at a few times, however many spans it holds."""
    seeds: list[list[int]] = []
    for start, end in sorted(s[1:] for s in base):
        if seeds and start <= seeds[-1][1]:
            seeds[-1][1] = max(end, seeds[-1][1])
        else:
            seeds.append([start, end])
    words = [m.span() for m in TOKEN.finditer(text)]  # all words that hold a digit or an @, so all that seeds stand in
    met, k = [], 0  # (start, end, seed, where its words begin and end)
    for start, end in seeds:
        while words[k][1] <= start:
            k += 1
        last = k
        while words[last][1] < end:
            last += 1
        met.append((start, end, True, words[k][0], words[last][1]))
    k = 0
    for begin, stop in words:
        while k < len(seeds) and seeds[k][1] <= begin:
            k += 1
        if k < len(seeds) and seeds[k][0] < stop:
            continue
        start, end = begin, stop
        while start < end and text[start] in EDGES:
            start += 1
        while end > start and text[end - 1] in EDGES:
            end -= 1
        if "@" in text[start:end] or len(DIGIT.findall(text, start, end)) >= 3:
            met.append((start, end, False, begin, stop))
    before, after = _cached(_before, text), _cached(_after, text)
    out = []
    for start, end, seed, begin, stop in sorted(met):
        value = text[start:end]
        out.append({"start": start, "end": end, "value": xxhash.xxh64_intdigest(value.lower().encode()) - (1 << 63), "patterns": patterns_of(kind_of(value), *before(begin), *after(stop)), "seed": seed})
    return out


def _cached(f, text: str):
    known: dict[int, tuple[str, str]] = {}
    return lambda at: known[at] if at in known else known.setdefault(at, f(text, at))


def _before(text: str, at: int) -> tuple[str, str]:
    """The two words of the line before a place, the nearer one last."""
    found: list[str] = []
    while len(found) < 2:
        while at and text[at - 1] in " \t\v\f\r":
            at -= 1
        if not at or text[at - 1] == "\n":
            return FIRST, found[0] if found else FIRST
        end = at
        while at and text[at - 1] not in BLANKS:
            at -= 1
        found.insert(0, word_of(text[at:end]))
    return found[0], found[1]


def _after(text: str, at: int) -> tuple[str, str]:
    """The two words of the line after a place."""
    found: list[str] = []
    while len(found) < 2:
        while at < len(text) and text[at] in " \t\v\f\r":
            at += 1
        if at == len(text) or text[at] == "\n":
            return (*found, LAST, LAST)[:2]
        m = WORD.match(text, at)
        found.append(word_of(m[0]))
        at = m.end()
    return found[0], found[1]


TOKEN_TYPE = "array<struct<start:int,end:int,value:long,patterns:array<string>,seed:boolean>>"
SCANNED = f"rid long, doc_id long, text_hash long, base array<struct<kind:int,start:int,end:int>>, tokens {TOKEN_TYPE}"
ARROW = pa.schema(
    [("rid", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("base", pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])))]
    + [("tokens", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.int64()), ("patterns", pa.list_(pa.string())), ("seed", pa.bool_())])))]
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for rid, doc_id, text in zip(*(c.to_pylist() for c in b.columns)):
            base = base_spans(text or "")
            tokens = _tokens(text, base) if text and (base or "@" in text or DIGIT.search(text)) else []
            rows.append({"rid": rid, "doc_id": doc_id, "text_hash": xxhash.xxh64_intdigest((text or "").encode()) - (1 << 63), "base": [{"kind": k, "start": s, "end": e} for k, s, e in base], "tokens": tokens})
        yield pa.RecordBatch.from_pylist(rows, schema=ARROW)


def scan(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> (rid, doc_id, text_hash, base, tokens), written once; rid tells repeated rows apart."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), "text")
    return written(rows.mapInArrow(_scan, SCANNED), "pii")


#: Normal quantile of the lower bound; parts that edges of one pattern or instance are dealt out to in joins.
Z, SALTS = 1.645, 16


def lower_bound(known: Column, n: Column) -> Column:
    """Wilson's lower bound of the share known / n."""
    p, zz = known / n, Z * Z
    return (p + zz / (2 * n) - Z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n)


def plain_lower_bound(known: int, n: int) -> float:
    p = known / n
    return (p + Z * Z / (2 * n) - Z * math.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)


def _salted(df: DataFrame) -> DataFrame:
    """Each row once a salt, for joins with edges.  Never broadcast: the size that plans estimate for it does not count the salts."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")


def graph(scanned: DataFrame, support: int) -> tuple[DataFrame, DataFrame]:
    """(edges (pattern, value, salt, text), seeds (value)): distinct pairs.  Patterns of fewer than `support` values can't count and are left out
    before anything is joined by value, which takes the patterns of chance away from values that stand everywhere."""
    found = scanned.select("text_hash", F.explode("tokens").alias("t"))
    seeds = found.where("t.seed").select("t.value").distinct()
    pairs = found.select("text_hash", "t.value", F.explode(F.array_distinct("t.patterns")).alias("pattern"))
    salt = F.pmod(F.xxhash64("pattern", "value"), F.lit(SALTS)).cast("int").alias("salt")
    pairs = written(pairs.groupBy("pattern", "value").agg(F.min("text_hash").alias("text")).select("pattern", "value", salt, "text"), "pii-pairs")
    able = pairs.groupBy("pattern", "salt").agg(F.count("*").alias("n")).groupBy("pattern").agg(F.sum("n").alias("n")).where(F.col("n") >= support)
    return written(pairs.join(_salted(able), ["pattern", "salt"]), "pii-edges"), written(seeds, "pii-seeds")


def scored_patterns(edges: DataFrame, known: DataFrame, support: int, confidence: float) -> DataFrame:
    """(pattern, score) of the patterns that count: enough known values, in two texts at least, and a score of `confidence`."""
    met = edges.join(_salted(known.select("value")), ["value", "salt"])
    parts = met.groupBy("pattern", "salt").agg(F.count("*").alias("k"), F.min("text").alias("t0"), F.max("text").alias("t1"), F.first("n").alias("n"))
    whole = parts.groupBy("pattern").agg(F.sum("k").alias("k"), F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.first("n").alias("n"))
    good = whole.where((F.col("k") >= support) & (F.col("t0") < F.col("t1"))).withColumn("score", lower_bound(F.col("k"), F.col("n")))
    return good.where(F.col("score") >= confidence).select("pattern", "score")


def scored_instances(edges: DataFrame, patterns: DataFrame, confidence: float) -> DataFrame:
    """(value, score) of the instances that count: 1 less the chance that all of their patterns err."""
    met = edges.join(_salted(patterns), ["pattern", "salt"])
    parts = met.groupBy("value", "salt").agg(F.sum(F.log1p(-F.col("score"))).alias("miss"))
    return parts.groupBy("value").agg((1 - F.exp(F.sum("miss"))).alias("score")).where(F.col("score") >= confidence)


def bootstrap(scanned: DataFrame, confidence: float = 0.6, support: int = 5) -> tuple[DataFrame, DataFrame]:
    """(patterns (pattern, score), found (value)): the patterns of the last round, and the values that became known beside the seeds.

    Rounds end when one finds nothing new.  More known values never lower a pattern's score, nor more patterns a value's, so what is known
    only grows, by a value a round at least, and the end is reached.
    """
    edges, seeds = graph(scanned, support)
    known, n = seeds, seeds.count()
    while True:
        good = written(scored_patterns(edges, known, support, confidence), "pii-patterns")
        known = written(seeds.unionByName(scored_instances(edges, good, confidence).select("value")).distinct(), "pii-known")
        now = known.count()
        if now == n:
            return good, known.join(seeds, "value", "left_anti")
        n = now


def extract(docs: DataFrame, confidence: float = 0.6, support: int = 5) -> DataFrame:
    """docs (doc_id, text) -> (rid, doc_id, base, found), a row for each row; found: spans that patterns add."""
    scanned = scan(docs)
    tokens = scanned.select("rid", F.explode("tokens").alias("t")).where("not t.seed").select("rid", "t.value", F.struct("t.start", "t.end").alias("span"))
    tokens = tokens.withColumn("salt", F.pmod("rid", F.lit(SALTS)).cast("int"))
    added = tokens.join(_salted(bootstrap(scanned, confidence, support)[1]), ["value", "salt"]).groupBy("rid").agg(F.array_sort(F.collect_list("span")).alias("found"))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    return scanned.select("rid", "doc_id", "base").join(added, "rid", "left").withColumn("found", F.coalesce("found", empty))


def listed(base: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(base, lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start, s.end)), ",")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "documents", "doc_id", "text"))
    count = lambda i, k: F.size(F.filter("base", lambda s: s.kind == i)).cast("long").alias(f"n_{k}")
    more = F.transform("found", lambda s: F.concat_ws(":", F.lit("id"), s.start, s.end))
    spans = F.array_join(F.concat(F.filter(F.array(listed(F.col("base"))), lambda x: x != ""), more), ",")
    return out.select("doc_id", *(count(i, k) for i, k in enumerate(KINDS)), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), spans.alias("spans"))
