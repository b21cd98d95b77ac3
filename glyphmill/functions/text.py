"""String helpers whose results follow Unicode code points, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that stripping removes (Java's trim and \\s know less).
SPACE = r"[\u0009-\u000D\u001C- \u0085   -     　]"


def let(value: Column, body) -> Column:
    """body(value), with the value computed once and the expression kept small."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def leading(text: Column) -> Column:
    """Code points of white space before the text."""
    return F.length(text) - F.length(F.regexp_replace(text, f"^{SPACE}+", ""))


def count_of(text: Column, needle: str) -> Column:
    """Occurrences of a fixed string."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def matches(text: Column, pattern: str, group: int = 1) -> Column:
    """Array of (start, end, source, value), from the lengths of matches and of what lies between them.

    A look-around sees the whole text; offsets are code points; one pass each for matches and gaps, then one fold.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.split(text, pattern, -1)
    rows = F.zip_with(F.arrays_zip(whole.alias("m"), value.alias("v")), F.slice(gaps, 1, F.size(whole)), lambda x, g: F.struct(x["m"].alias("m"), x["v"].alias("v"), F.length(g).alias("gap")))
    kind = "array<struct<start:int,end:int,source:string,value:string>>"

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("source"), x["v"].alias("value")))).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    return F.when(F.regexp_like(text, F.lit(pattern)), F.aggregate(rows, begin, step, lambda acc: acc["out"])).otherwise(F.array().cast(kind))


def line_at(text: Column, offset: Column) -> Column:
    """Line number of an offset: newlines before it, plus one."""
    return count_of(F.substring(text, F.lit(1), offset), "\n") + 1


def splice(text: Column, edits: Column) -> Column:
    """The text with (start, end, after) edits, which are sorted and do not overlap, put in from left to right."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, e["start"] - acc["at"])
        return F.struct(e["end"].alias("at"), F.concat(acc["out"], gap, e["after"]).alias("out"))

    return F.aggregate(edits, begin, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
