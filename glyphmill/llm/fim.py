"""Fill-in-the-middle: texts cut in three and put together in another order, by ropes.

A text becomes a rope: a balanced tree whose leaves hold a run of whole units and, with every inner node, the counts of units and
of code points below.  Both cuts are splits at a unit rank, which follow one path each and share all other subtrees; the output is
a concatenation of three subtrees and the sentinels.  ``restore`` makes a rope of the output, finds the sentinels, splits there and
concatenates the parts in their first order.

Units are code points, words (a run of non-blanks with the blanks after it; leading blanks are a unit) or lines (with their line
break).  Forms: ``psm`` is <P>prefix<S>suffix<M>middle, ``spm`` is <S>suffix<P>prefix<M>middle, ``plain`` is the text itself.  Plain
are empty texts, texts that hold a sentinel (so that the way back is unique) and the share of rows that the key deals out.

Where a text is cut and its form depend on (seed, doc_id) alone, through sha256: the first four groups of eight hex digits are h1 to
h4; the prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) units and the middle after the larger; plain if h3 % 100 is
not below ``rate``; else spm if h4 % 100 is below ``spm``.

Null texts count as empty.  A null id is hashed as no digits; rows of one id get the same numbers, repeated rows the same output, and
every row stays.  Very long texts are held one batch at a time.  An empty table gives no rows.  Only doc_id and text are read, so
other columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from glyphmill.llm.common import small_batches, table

#: Sentinels before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Code points of a leaf, about.
LEAF = 4096
UNITS = {"chars": None, "words": re.compile(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+"), "lines": re.compile(r"[^\n]*\n|[^\n]+")}


@dataclass(frozen=True, slots=True)
class Leaf:
    """A run of whole units; ends has the end of each in the text, or is None where a unit is a code point."""

    text: str
    ends: tuple[int, ...] | None

    @property
    def units(self) -> int:
        return len(self.text) if self.ends is None else len(self.ends)

    @property
    def points(self) -> int:
        return len(self.text)

    def split(self, k: int) -> tuple[Leaf, Leaf]:
        if self.ends is None:
            return Leaf(self.text[:k], None), Leaf(self.text[k:], None)
        at = self.ends[k - 1] if k else 0
        return Leaf(self.text[:at], self.ends[:k]), Leaf(self.text[at:], tuple(e - at for e in self.ends[k:]))


@dataclass(frozen=True, slots=True)
class Node:
    left: Rope
    right: Rope
    units: int
    points: int


Rope = Leaf | Node
EMPTY = Leaf("", None)


def joined(a: Rope, b: Rope) -> Rope:
    """Concatenation in constant time; empty ropes vanish."""
    if not a.points:
        return b
    if not b.points:
        return a
    return Node(a, b, a.units + b.units, a.points + b.points)


def rope(text: str, unit: str = "chars", leaf: int = LEAF) -> Rope:
    """A balanced rope of a text; a unit never spans two leaves."""
    pattern = UNITS[unit]
    if pattern is None:
        level: list[Rope] = [Leaf(text[at : at + leaf], None) for at in range(0, len(text), leaf)]
    else:
        level, begin, ends = [], 0, []
        for m in pattern.finditer(text):
            ends.append(m.end() - begin)
            if ends[-1] >= leaf:
                level.append(Leaf(text[begin : m.end()], tuple(ends)))
                begin, ends = m.end(), []
        if ends:
            level.append(Leaf(text[begin:], tuple(ends)))
    while len(level) > 1:
        level = [joined(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else EMPTY


def split(r: Rope, k: int) -> tuple[Rope, Rope]:
    """The first k units and the rest; nodes off the path are shared."""
    if k <= 0:
        return EMPTY, r
    if k >= r.units:
        return r, EMPTY
    if isinstance(r, Leaf):
        return r.split(k)
    if k < r.left.units:
        a, b = split(r.left, k)
        return a, joined(b, r.right)
    a, b = split(r.right, k - r.left.units)
    return joined(r.left, a), b


def flat(r: Rope) -> str:
    out, stack = [], [r]
    while stack:
        at = stack.pop()
        if isinstance(at, Leaf):
            out.append(at.text)
        else:
            stack += (at.right, at.left)
    return "".join(out)


def arranged(parts: tuple[Rope, Rope, Rope], form: str, sentinels: tuple[str, str, str] = SENTINELS) -> Rope:
    """Prefix, middle and suffix in the order of a form, each behind its sentinel."""
    prefix, middle, suffix = parts
    p, s, m = (Leaf(x, None) for x in sentinels)
    order = (p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle)
    out: Rope = EMPTY
    for x in order:
        out = joined(out, x)
    return out


def restored(output: str, form: str, sentinels: tuple[str, str, str] = SENTINELS) -> str:
    """The text that an output was made of; ValueError if the sentinels don't stand as the form says."""
    if form == "plain":
        return output
    first, second, last = (sentinels[0], sentinels[1], sentinels[2]) if form == "psm" else (sentinels[1], sentinels[0], sentinels[2])
    at_second = output.find(second, len(first))
    at_last = output.find(last, max(at_second, 0))
    if not output.startswith(first) or at_second < 0 or at_last < 0:
        raise ValueError(f"not an output of form {form}: {output[:40]!r}")
    head, rest = split(rope(output), at_second)
    body, middle = split(rest, at_last - at_second)
    one, two, middle = split(head, len(first))[1], split(body, len(second))[1], split(middle, len(last))[1]
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return flat(joined(joined(prefix, middle), suffix))


def sound(sentinels: tuple[str, str, str]) -> None:
    """Refuses sentinels that could arise where two parts meet, as then the way back is not unique."""
    if len(set(sentinels)) < 3 or not all(sentinels):
        raise ValueError("three different sentinels are needed")
    for a in sentinels:
        for b in sentinels:
            if a != b and a in b or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)) + (a != b))):
                raise ValueError(f"sentinels {a!r} and {b!r} overlap")


MADE = "doc_id long, n long, form string, prefix_units long, middle_units long, prefix_chars long, middle_chars long, output string"
MADE_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_units", pa.int64()), ("middle_units", pa.int64()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]
)


def made(text: str, h: tuple[int, int, int, int], unit: str, rate: int, spm: int, sentinels: tuple[str, str, str]) -> tuple:
    """(n, form, prefix_units, middle_units, prefix_chars, middle_chars, output) of one text."""
    whole = rope(text, unit)
    n = whole.units
    if not text or any(s in text for s in sentinels) or h[2] % 100 >= rate:
        return n, "plain", None, None, None, None, text
    form = "spm" if h[3] % 100 < spm else "psm"
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    head, suffix = split(whole, j)
    prefix, middle = split(head, i)
    return n, form, i, j - i, prefix.points, middle.points, flat(arranged((prefix, middle, suffix), form, sentinels))


def transformed(docs: DataFrame, unit: str = "chars", seed: int = 1, rate: int = 90, spm: int = 20, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n, form, prefix_units, middle_units, prefix_chars, middle_chars, output); the last five but output are null if plain."""
    sound(sentinels)
    small_batches(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i}") for i in range(4)]
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *h)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 250):
                b = whole.slice(at, 250)
                numbers = zip(*(b.column(2 + i).to_pylist() for i in range(4)))
                out = [made(t, h, unit, rate, spm, sentinels) for t, h in zip(b.column(1).to_pylist(), numbers)]
                columns = [pa.array(list(c), type=f.type) for c, f in zip(zip(*out), list(MADE_SCHEMA)[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], schema=MADE_SCHEMA)

    return rows.mapInArrow(run, MADE)


def restore(outputs: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """outputs (doc_id, form, output, ...) -> all their columns and text, rebuilt from output and form alone.  A null output stays null."""
    sound(sentinels)
    small_batches(outputs.sparkSession)
    names = outputs.columns
    kept = [c for c in names if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 250):
                b = whole.slice(at, 250)
                texts = [None if o is None else restored(o, f, sentinels) for o, f in zip(b.column("output").to_pylist(), b.column("form").to_pylist())]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, "text"])

    source = outputs.select(*kept)
    return source.mapInArrow(run, StructType([*source.schema.fields, StructField("text", StringType())]))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = restore(transformed(table(spark, sf_dir, "documents", "doc_id", "text")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output"), 256).alias("output_sha256"), F.sha2(F.col("text"), 256).alias("restored_sha256"))


ORACLE_SQL = {
    "op11_fill_in_middle": """
with d as (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as s from documents),
h as (select *, cast('0x' || substr(s, 1, 8) as bigint) as h1, cast('0x' || substr(s, 9, 8) as bigint) as h2,
             cast('0x' || substr(s, 17, 8) as bigint) as h3, cast('0x' || substr(s, 25, 8) as bigint) as h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as i, greatest(h1 % (n + 1), h2 % (n + 1)) as j,
             case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain'
                  when h4 % 100 < 20 then 'spm' else 'psm' end as form from h),
p as (select *, substr(t, 1, i) as a, substr(t, i + 1, j - i) as b, substr(t, j + 1, n - j) as z from c)
select doc_id, n, form, case when form <> 'plain' then i end as prefix_chars, case when form <> 'plain' then j - i end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || a || '<S>' || z || '<M>' || b else '<S>' || z || '<P>' || a || '<M>' || b end) as output_sha256,
       sha256(t) as restored_sha256
from p
"""
}
