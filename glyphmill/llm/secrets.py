"""Secret scans through a trigram inverted index; DataFrame functions only.

Each rule's regular expression yields a Boolean trigram query (``trigrams.query``).

1. ``postings``: one pass over the texts writes a posting (trigram, document key) for each trigram that some rule asks for;
   no other posting could be read.
2. ``candidates``: a rule's postings are intersected or united as its query says.  Postings are dealt out by document, so a
   trigram that stands in most documents is no hot key.
3. Candidates are verified by the rule's regular expression.  A bitmap over hashed keys, of eight bits a candidate (up to
   ``MOST_BITS``, 32 MB), keeps nearly all other documents out of the join, so texts of candidates alone are shuffled; where it
   lets others through, that costs time only.
4. Rules without a mandatory trigram (runs of hex digits) scan all texts, in the pass that writes the postings.

A document's key is its id and 128 bits of its text's hash: rows share findings only if both agree, so repeated rows find the
same spans.  Null and empty texts have none, null ids are ids like others, an empty table gives no rows.  ``scan`` reads
doc_id and text alone; ``redact`` keeps all other columns as they are, under whatever names.  Spans of one kind are the
leftmost non-overlapping matches; those below the rule's length are dropped, without retries.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import trigrams
from glyphmill.llm.common import cut, table, written


@dataclass(frozen=True)
class Rule:
    """least: the fewest characters of the group for a match to count."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base rules (assign, access, hex), then those that the method adds.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"(AKIA)([A-Z0-9]+)", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 1),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    Rule("urlauth", r"://[A-Za-z0-9._%+-]{1,64}:[^\x20\x09-\x0D/@:]{1,64}@", 0, 1),
)
RULES = (*BASE, *ADDED)
#: Bits of the candidates' bitmap, at least and at most (32 MB).
LEAST_BITS, MOST_BITS = 1 << 15, 1 << 28


def _vocabulary(rules: tuple[Rule, ...]) -> list[str]:
    return list(dict.fromkeys(t for r in rules for t in trigrams.leaves(trigrams.query(r.pattern))))


SPANS = "array<struct<start:int,end:int,kind:string>>"


def key_of(doc_id: Column, text: Column) -> Column:
    """A document's key: rows share it if they share id and text."""
    return F.struct(doc_id.cast("long").alias("id"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def first_pass(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs (doc_id, text) -> (key, trigrams, spans), a row for each row: the trigrams that some rule asks for, and the spans of rules without a
    query.  No filter stands here: the optimiser would move it, and all that it looks at, to the scan and evaluate that twice."""
    words, full = _vocabulary(rules), [r for r in rules if trigrams.query(r.pattern) is None]
    found = F.filter(F.array(*(F.when(F.contains(F.col("low"), F.lit(w)), F.lit(w)) for w in words)).cast("array<string>"), lambda x: x.isNotNull())
    scanned = F.concat(*(F.coalesce(spans(F.col("text"), r), F.array().cast(SPANS)) for r in full)) if full else F.array().cast(SPANS)
    low = docs.select("doc_id", "text", F.lower("text").alias("low"))
    return low.select(key_of(F.col("doc_id"), F.col("text")).alias("key"), found.alias("trigrams"), scanned.alias("spans"))


def postings(pass_one: DataFrame) -> DataFrame:
    """first_pass -> (trigram, key): the inverted index of the trigrams that rules ask for."""
    return pass_one.select(F.explode("trigrams").alias("trigram"), "key")


def _asks(need, words: list[str], mask: Column) -> Column:
    """A formula over a bit mask: bit i is the i-th trigram."""
    if isinstance(need, str):
        return mask.bitwiseAND(F.lit(1 << words.index(need))) != 0
    parts = [_asks(p, words, mask) for p in need[1:]]
    out = parts[0]
    for p in parts[1:]:
        out = (out & p) if need[0] == "and" else (out | p)
    return out


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """postings -> (key, kinds): the rules whose query a document's postings satisfy; rules without a query are left out."""
    words = _vocabulary(rules)
    masks = []  # 63 trigrams a mask
    for at in range(0, len(words), 63):
        own = words[at : at + 63]
        bits = F.lit(0).cast("long")
        for i, w in enumerate(own):
            bits = F.when(F.col("trigram") == w, F.lit(1 << i)).otherwise(bits)
        masks.append((own, F.bit_or(bits).alias(f"m{at}")))
    by_doc = index.groupBy("key").agg(*(m for _, m in masks))

    def ask(need) -> Column:
        if isinstance(need, str):
            own, at = next((own, 63 * k) for k, (own, _) in enumerate(masks) if need in own)
            return _asks(need, own, F.col(f"m{at}"))
        parts = [ask(p) for p in need[1:]]
        out = parts[0]
        for p in parts[1:]:
            out = (out & p) if need[0] == "and" else (out | p)
        return out

    hits = [F.when(ask(q), F.lit(r.kind)) for r in rules if (q := trigrams.query(r.pattern)) is not None]
    return by_doc.select("key", F.filter(F.array(*hits), lambda x: x.isNotNull()).alias("kinds")).where("size(kinds) > 0")


def spans(text: Column, rule: Rule) -> Column:
    """Array of (start, end, kind) of a rule in a text, in code points, from the lengths of what lies between matches."""
    p = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    if rule.group:
        sized = F.zip_with(whole, F.regexp_extract_all(text, p, F.lit(rule.group)), lambda m, g: F.struct(F.length(m).alias("n"), (F.length(g) >= rule.least).alias("ok")))
    else:
        sized = F.transform(whole, lambda m: F.struct(F.length(m).alias("n"), (F.length(m) >= rule.least).alias("ok")))
    between = F.transform(F.split(text, rule.pattern, -1), lambda s: F.length(s))
    steps = F.zip_with(sized, F.slice(between, 1, F.greatest(F.size(sized), F.lit(0))), lambda m, gap: F.struct(m.n.alias("n"), m.ok.alias("ok"), gap.alias("gap")))
    nothing = F.lit(None).cast(SPANS)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, s: Column) -> Column:
        start = acc.at + s.gap
        one = F.array(F.struct(start.alias("start"), (start + s.n).alias("end"), F.lit(rule.kind).alias("kind")))
        return F.struct((start + s.n).alias("at"), F.when(s.ok, F.concat(acc.out, one)).otherwise(acc.out).alias("out"))

    return F.when(F.regexp_like(text, p), F.aggregate(steps, begin, step, lambda acc: acc.out)).otherwise(nothing)


def _flagged(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with a column key -> with near: whether the key may be in found, by a bitmap in rows of 4 KB."""
    n = found.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (8 * n).bit_length()))
    slot = F.pmod("key.a", F.lit(bits))
    bitmaps = found.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("_bitmap"))
    placed = docs.withColumns({"_bucket": F.bitmap_bucket_number(slot), "_bit_at": F.bitmap_bit_position(slot)}).join(F.broadcast(bitmaps), "_bucket", "left")
    byte = F.conv(F.hex(F.expr("substring(_bitmap, cast(_bit_at div 8 + 1 as int), 1)")), 16, 10).cast("int")
    near = F.coalesce(F.getbit(byte, (F.col("_bit_at") % 8).cast("int")) == 1, F.lit(False))
    return placed.withColumn("near", near).select(*docs.columns, "near")


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs (doc_id, text) -> (key, spans) of the documents that have spans, each key once; spans by start, then rule."""
    asked = [r for r in rules if trigrams.query(r.pattern) is not None]
    order = {r.kind: i for i, r in enumerate(rules)}
    one = written(first_pass(docs, rules), "secrets-index")
    both = one.where("size(spans) > 0").select("key", "spans").dropDuplicates(["key"])
    if asked:
        found = cut(candidates(postings(one), rules))
        keyed = docs.select("text", key_of(F.col("doc_id"), F.col("text")).alias("key"))
        verified = _flagged(keyed, found).where("near").drop("near").join(found, "key").dropDuplicates(["key"])
        checked = F.concat(*(F.coalesce(F.when(F.array_contains("kinds", r.kind), spans(F.col("text"), r)), F.array().cast(SPANS)) for r in asked))
        both = both.unionByName(verified.select("key", checked.alias("spans")).where("size(spans) > 0"))
    rank = F.create_map(*(x for k, i in order.items() for x in (F.lit(k), F.lit(i))))
    merged = both.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"))  # two rows at most
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s.start.alias("start"), rank[s.kind].alias("rank"), s.end.alias("end"), s.kind.alias("kind"))))
    return merged.select("key", ordered.alias("spans"))


def listed(column: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def _with_spans(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """docs (doc_id, text, ...) -> with spans, null where nothing was found.  Rows without a finding pass through unmoved; the bitmap keeps them out of the join."""
    hits = cut(find(docs.select("doc_id", "text"), rules))
    flagged = _flagged(docs.withColumn("key", key_of(F.col("doc_id"), F.col("text"))), hits)
    near = flagged.where("near").join(hits, "key", "left").select(*docs.columns, "spans")
    return flagged.where("not near").select(*docs.columns, F.lit(None).cast(hits.schema["spans"].dataType).alias("spans")).unionByName(near)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, spans), a row for each row, an empty array where nothing was found."""
    found = _with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rules)
    return found.select("doc_id", F.coalesce("spans", F.array()).alias("spans"))


def masked_text(text: Column, column: Column) -> Column:
    """The text with each maximal run of overlapping spans replaced by [SECRET]."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc.at + 1, s.start - acc.at)
        fresh = F.struct(s.end.alias("at"), F.concat(acc.out, gap, F.lit("[SECRET]")).alias("out"))
        return F.when(s.start >= acc.at, fresh).otherwise(F.struct(F.greatest(acc.at, s.end).alias("at"), acc.out.alias("out")))

    return F.aggregate(column, begin, step, lambda acc: F.concat(acc.out, F.substring(text, acc.at + 1, F.length(text))))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, counted: str | None = None) -> DataFrame:
    """All rows and columns of docs; texts with [SECRET] for what a rule found.  counted: a column for the text's length, set where the text changes."""
    own = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    found = _with_spans(own, rules)
    hit = F.col("spans").isNotNull()
    text = F.when(hit, masked_text(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    found = found.withColumn("changed", text)
    new = {"text": F.col("changed")} | ({counted: F.when(hit, F.length("changed").cast("long")).otherwise(F.col(f"row.`{counted}`"))} if counted else {})
    return found.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents", "doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s.kind.isin(*(r.kind for r in BASE)))
    return found.select("doc_id", *(count(r.kind) for r in BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _sql() -> str:
    """The spans of every rule: starts follow from the lengths of matches and of what lies between them."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    hits = " union all ".join(
        f"select r, {i} as place, {quoted(x.kind)} as kind, {x.least} as least, regexp_extract_all(t, {quoted(x.pattern)}) as m, regexp_extract_all(t, {quoted(x.pattern)}, {x.group}) as g, string_split_regex(t, {quoted(x.pattern)}) as s from d where regexp_matches(t, {quoted(x.pattern)})"
        for i, x in enumerate(RULES)
    )
    own = ", ".join(f"cast(count(*) filter (kind = '{x.kind}') as bigint) as n_{x.kind}" for x in BASE)
    base = f"kind in ({', '.join(quoted(x.kind) for x in BASE)})"
    listed_sql = "string_agg(concat(kind, ':', a, ':', b), ',' order by a, place)"
    return f"""
with d as (select row_number() over () as r, cast(doc_id as bigint) as doc_id, coalesce(text, '') as t from documents),
hits as ({hits}),
one as (select r, place, kind, least, unnest(range(1, len(m) + 1)) as i, unnest(list_transform(m, lambda x: len(x))) as n, unnest(list_transform(g, lambda x: len(x))) as grp, unnest(list_transform(s[1:len(m)], lambda x: len(x))) as gap from hits),
placed as (select *, sum(n + gap) over (partition by r, place order by i) as b from one),
spans as (select r, place, kind, cast(b - n as bigint) as a, cast(b as bigint) as b from placed where grp >= least),
found as (select r, {own}, {listed_sql} filter ({base}) as base, {listed_sql} as spans from spans group by r)
select d.doc_id, {", ".join(f"coalesce(n_{x.kind}, 0) as n_{x.kind}" for x in BASE)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join found using (r)
"""


ORACLE_SQL = {"op9_secret_scan": _sql()}
