"""Word packages as relations: members, paragraphs, counters; admission and verdicts over them; edits of paragraphs.

A package is one binary row, read by one task; its members and paragraphs are rows.  Markup with a document type is refused
by the parser itself, in any encoding, so no entity is ever expanded.  A package that can't be read is a row that says so.
"""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from contextlib import suppress
from xml.etree import ElementTree as ET
from xml.parsers import expat

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.operators.splicing import Edit, Unsafe, decoded, paragraph_texts, spliced
from glyphmill.schemas import MEMBER, PARAGRAPH

#: Namespaces, story parts, required members, limits of a package.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
STORY = r"^word/(document|header\d+|footer\d+|footnotes|endnotes|comments)\.xml$"
REQUIRED = ("[Content_Types].xml", "word/document.xml")
MOST_BYTES, MOST_MEMBERS, MOST_MEMBER, MOST_TOTAL, MOST_RATIO = 1_000_000_000, 100_000, 750_000_000, 2_000_000_000, 2_500
#: Elements that structure counts.
COUNTED = {"tables": ("tbl",), "drawings": ("drawing",), "pictures": ("pict",), "hyperlinks": ("hyperlink",), "bookmarks": ("bookmarkStart",), "comments": ("commentRangeStart",), "revisions": ("ins", "del"), "sections": ("sectPr",)}


def read_packages(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the .docx and .docm files of a folder, each path once."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.doc[xm]").load(folder)
    return files.select("path", "content").dropDuplicates(["path"])


#: What a package that is no sound archive raises.
BROKEN = (zipfile.BadZipFile, zlib.error, EOFError, OSError, NotImplementedError, RuntimeError, ValueError)


def declared(data: bytes) -> list[tuple[str, str]]:
    """Namespace declarations (prefix, uri) of a part's root, in order; Unsafe if it declares a document type or an entity."""
    names: list[list[tuple[str, str]]] = []

    def refuse(*_) -> None:
        raise Unsafe("markup declares a document type")

    def start(_, attributes: list[str]) -> None:
        if not names:
            names.append([(k.partition(":")[2], v) for k, v in zip(attributes[::2], attributes[1::2]) if k == "xmlns" or k.startswith("xmlns:")])

    reader = expat.ParserCreate()
    reader.ordered_attributes = True
    reader.StartDoctypeDeclHandler = reader.EntityDeclHandler = reader.ExternalEntityRefHandler = refuse
    reader.StartElementHandler = start
    try:
        reader.Parse(data, True)
    except expat.ExpatError as e:
        raise Unsafe(f"markup is not well formed: {e}") from None
    return names[0]


def parse(data: bytes) -> ET.Element:
    declared(data)
    return ET.fromstring(data)


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows += [(path, i.filename, i.file_size, i.compress_size, i.flag_bits, i.CRC) for i in z.infolist()]
            except BROKEN:
                rows.append((path, None, 0, 0, 0, 0))
        yield pd.DataFrame(rows, columns=["path", "name", "size", "csize", "flags", "crc"])


def members(packages: DataFrame) -> DataFrame:
    """A row for each member; one without a name for a package that can't be read."""
    return packages.mapInPandas(_members, MEMBER)


def admission(rows: DataFrame) -> DataFrame:
    """(path, error): the first reason to refuse a package, or null.  The order of reasons is fixed."""
    g = rows.groupBy("path").agg(
        F.count("*").alias("n"), F.count_distinct("name").alias("names"), F.max("size").alias("largest"), F.sum("size").alias("total"),
        F.max(F.col("size") / F.greatest(F.col("csize"), F.lit(1))).alias("ratio"), F.max(F.col("flags").bitwiseAND(1)).alias("locked"), F.sum("csize").alias("packed"),
        *(F.max(F.coalesce(F.col("name") == r, F.lit(False)).cast("int")).alias(f"has{i}") for i, r in enumerate(REQUIRED)), F.bool_or(F.col("name").isNull()).alias("unread"),
    )
    required = F.col("has0") + F.col("has1")
    error = (
        F.when(F.col("unread"), "package can't be read").when(F.col("packed") > MOST_BYTES, "package is too large").when(F.col("n") > MOST_MEMBERS, "too many members").when(F.col("n") != F.col("names"), "duplicate member")
        .when(required < len(REQUIRED), "required part is missing").when(F.col("locked") > 0, "encrypted member").when(F.col("largest") > MOST_MEMBER, "member is too large")
        .when(F.col("total") > MOST_TOTAL, "expanded package is too large").when(F.col("ratio") > MOST_RATIO, "suspicious compression ratio")
    )
    return g.select("path", error.alias("error"))


def is_story(name: Column) -> Column:
    return F.regexp_like(name, F.lit(STORY))


def _stories(content: bytes | zipfile.ZipFile) -> Iterator[tuple[str, bytes]]:
    if not isinstance(content, zipfile.ZipFile):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            yield from _stories(z)
        return
    for name in sorted(n for n in content.namelist() if re.match(STORY, n)):
        yield name, content.read(name)


def texts(data: bytes) -> list[str]:
    """Texts of a part's paragraphs, as edits of it count offsets; Unsafe if it can't be read."""
    return paragraph_texts(decoded(data)[0])


def _paragraphs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            rows = []
            with suppress(*BROKEN):
                for name, data in _stories(content):
                    with suppress(Unsafe):
                        rows += [(path, name, i, t) for i, t in enumerate(texts(data))]
            yield pd.DataFrame(rows, columns=["path", "part", "paragraph_index", "text"])


def paragraphs(packages: DataFrame) -> DataFrame:
    """Paragraphs of the story parts that can be read; ``structure`` says which can't."""
    return packages.mapInPandas(_paragraphs, PARAGRAPH)


def scanned(parts: DataFrame) -> DataFrame:
    """parts (path, part, content, error) -> (path, part, native, texts, error): formulas that are native already and the texts of paragraphs.

    A package that was refused and a part that can't be read are rows with an error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, part, content, error in zip(pdf["path"], pdf["part"], pdf["content"], pdf["error"]):
                own, native = [], 0
                if not error:
                    try:
                        own, native = texts(content), counters(content)["math"]
                    except (Unsafe, ET.ParseError) as e:
                        error = f"STORY_XML_INVALID: {e}"
                rows.append((path, part, native, own, error or None))
            yield pd.DataFrame(rows, columns=["path", "part", "native", "texts", "error"])

    return parts.select("path", "part", "content", "error").mapInPandas(run, "path string, part string, native long, texts array<string>, error string")


#: Names that counters meet, as the parser writes them.
PARAGRAPH_NAME, MATH_NAME = f"{W}p"[1:], f"{M}oMath"[1:]
COUNTED_NAMES = {n: [f"{W}{tag}"[1:] for tag in tags] for n, tags in COUNTED.items()}


def counters(data: bytes) -> dict[str, int]:
    """Native formulas of a part, those outside of paragraphs, and the elements that structure counts, in one pass that builds no tree.

    What ``parse`` refuses is refused with the same words.
    """
    tally = dict.fromkeys((PARAGRAPH_NAME, MATH_NAME, *(x for names in COUNTED_NAMES.values() for x in names)), 0)
    inside = misplaced = 0

    def refuse(*_) -> None:
        raise Unsafe("markup declares a document type")

    def start(name: str, _) -> None:
        nonlocal inside, misplaced
        if name in tally:
            tally[name] += 1
            if name == PARAGRAPH_NAME:
                inside += 1
            elif name == MATH_NAME:
                misplaced += not inside

    def finish(name: str) -> None:
        nonlocal inside
        if name == PARAGRAPH_NAME:
            inside -= 1

    reader = expat.ParserCreate(namespace_separator="}")
    reader.StartDoctypeDeclHandler = reader.EntityDeclHandler = reader.ExternalEntityRefHandler = refuse
    reader.StartElementHandler, reader.EndElementHandler = start, finish
    try:
        reader.Parse(data, True)
    except expat.ExpatError:
        parse(data)
        raise
    return {"math": tally[MATH_NAME], "misplaced": misplaced} | {n: sum(tally[x] for x in names) for n, names in COUNTED_NAMES.items()}


def _counted(content: bytes | zipfile.ZipFile, known: dict[bytes, dict[str, int]] | None = None) -> Iterator[tuple[str, dict[str, int] | None, str | None]]:
    """(part, counters, error) of each story part of a package, which may be open already; one that can't be read is one part without a name.

    known: counters by a part's digest, so that a part that is the same in two packages is counted once.
    """
    known = {} if known is None else known
    try:
        for name, data in _stories(content):
            digest = hashlib.sha256(data).digest()
            try:
                if digest not in known:
                    known[digest] = counters(data)
                yield name, known[digest], None
            except (Unsafe, ET.ParseError) as e:
                yield name, None, f"STORY_XML_INVALID: {e}"
    except BROKEN as e:
        yield "", None, f"PACKAGE_UNREADABLE: {e}"


def _structure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["math", "misplaced", *COUNTED]
    for pdf in batches:
        rows, known = [], {}
        for path, content in zip(pdf["path"], pdf["content"]):
            for part, own, error in _counted(content, known):
                rows.append((path, part, *(own[n] if own else 0 for n in names), error))
        yield pd.DataFrame(rows, columns=["path", "part", *names, "error"])


def structure(packages: DataFrame) -> DataFrame:
    """Counters of each story part: native formulas, those outside of paragraphs, and structure; error: why it could not be read.

    A part that is the same in packages of one batch is counted once.
    """
    return packages.mapInPandas(_structure, "path string, part string, math long, misplaced long, " + ", ".join(f"{n} long" for n in COUNTED) + ", error string")


#: What must hold of a package that was written.
CHECKS = ("entries_equal", "unmodified_equal", "content_types_equal", "relations_equal", "structure_equal", "readable", "math_valid", "placement_valid")


def checked(before: bytes, after: bytes, expected: int) -> dict[str, bool]:
    """CHECKS of a package against the one it was made from; expected: how many native formulas it has more."""
    with zipfile.ZipFile(io.BytesIO(before)) as b, zipfile.ZipFile(io.BytesIO(after)) as a:
        old, new = ({i.filename: i.CRC for i in z.infolist()} for z in (b, a))
        names = [sorted(z.namelist()) for z in (b, a)]
        readable = a.testzip() is None
        known: dict[bytes, dict[str, int]] = {}
        parts = [{part: own for part, own, _ in _counted(z, known)} for z in (b, a)]
    kept = [n for n in old if not re.match(STORY, n)]
    totals = [{n: sum(c[n] for c in p.values() if c) for n in ("math", "misplaced", *COUNTED)} for p in parts]
    same = lambda some: all(new.get(n) == old[n] for n in some)
    return {
        "entries_equal": names[0] == names[1], "unmodified_equal": same(kept), "content_types_equal": old.get(REQUIRED[0]) == new.get(REQUIRED[0]),
        "relations_equal": same(n for n in old if n.endswith(".rels")), "structure_equal": all(totals[0][n] == totals[1][n] for n in COUNTED) and None not in parts[1].values(),
        "readable": readable, "math_valid": totals[1]["math"] - totals[0]["math"] == expected, "placement_valid": totals[1]["misplaced"] == 0,
    }


def verdicts(pairs: DataFrame) -> DataFrame:
    """pairs (path, before, after, expected) -> (path, CHECKS, valid, error); a pair that can't be read fails all checks, and error says why."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, before, after, expected in zip(pdf["path"], pdf["before"], pdf["after"], pdf["expected"]):
                try:
                    own, error = checked(before, after, expected), None
                except BROKEN as e:
                    own, error = dict.fromkeys(CHECKS, False), str(e)
                rows.append((path, *(own[c] for c in CHECKS), all(own.values()), error))
            yield pd.DataFrame(rows, columns=["path", *CHECKS, "valid", "error"])

    return pairs.select("path", "before", "after", "expected").mapInPandas(run, "path string, " + ", ".join(f"{c} boolean" for c in CHECKS) + ", valid boolean, error string")


def entry_comparison(entries: DataFrame) -> DataFrame:
    """entries (doc, side, name, crc, modified) -> a row for each document: equal names, unmodified members unchanged, relations unchanged."""
    b = entries.where("side = 'before'").groupBy("doc", "name").agg(F.min("crc").alias("b"), F.max("modified").alias("modified"))
    a = entries.where("side = 'after'").groupBy("doc", "name").agg(F.min("crc").alias("a"))
    both = b.join(a, ["doc", "name"], "full_outer")
    same = F.col("a").eqNullSafe(F.col("b"))
    return both.groupBy("doc").agg(
        F.bool_and(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("entries_equal"), F.bool_and(same | F.coalesce("modified", F.lit(False))).alias("unmodified_equal"),
        F.bool_and(same | ~F.col("name").endswith(".rels")).alias("relations_equal"), F.array_join(F.array_sort(F.collect_set(F.when(~same, F.col("name")))), ",").alias("changed"),
    )


def entry_sets(entries: DataFrame) -> DataFrame:
    """entries (doc, side, name) -> (doc, lost, new) of documents whose sides do not have the same members."""
    sides = entries.groupBy("doc", "name").agg(*(F.bool_or(F.col("side") == s).alias(s) for s in ("before", "after")))
    return sides.where("not (before and after)").groupBy("doc").agg(F.bool_or(~F.col("after")).alias("lost"), F.bool_or(~F.col("before")).alias("new"))


def story_names(rows: DataFrame) -> DataFrame:
    """rows (path, name) of members -> (path, names): the story parts of each package in order, as they are scanned."""
    return rows.where(is_story(F.col("name"))).groupBy("path").agg(F.array_sort(F.collect_set("name")).alias("names"))


def math_delta(counts: DataFrame, successes: DataFrame) -> DataFrame:
    """counts (doc, side, math), successes (doc, n) -> (doc, delta, valid)."""
    delta = counts.groupBy("doc").agg(F.sum(F.when(F.col("side") == "after", F.col("math")).otherwise(-F.col("math"))).alias("delta"))
    return delta.join(successes, "doc", "left").select("doc", "delta", (F.col("delta") == F.coalesce("n", F.lit(0))).alias("valid"))


def patch(content: bytes, edits: dict[tuple[str, int], list[tuple[int, int, bytes, bool]]], best_effort: bool = False) -> tuple[bytes, int, list[str]]:
    """A package with formulas put in; edits: (part, paragraph) -> spans with markup and display.  Other members are copied as they are.

    Returns the package, how many spans were replaced and the warnings; without best_effort the first one raises.
    """
    by: dict[str, dict[int, list[Edit]]] = {}
    for (part, i), spans in edits.items():
        by.setdefault(part, {})[i] = [Edit(*s) for s in spans]
    out, done, warnings = io.BytesIO(), 0, []
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w") as target:
        for info in z.infolist():
            data = z.read(info)
            if own := by.pop(info.filename, None):
                data, n, reasons = spliced(data, own, best_effort)
                done += n
                warnings += [f"UNSAFE_WORD_STRUCTURE: {reason}" for _, reason in reasons]
            target.writestr(info, data, compress_type=info.compress_type)
    if by:
        raise Unsafe(f"there is no part {min(by)}")
    return out.getvalue(), done, warnings


PATCHED = "path string, content binary, converted int, warnings array<string>, error string"


def _patched(path: str, content: bytes, items: Iterable[dict], failed: list[str], best_effort: bool) -> tuple:
    """A row of PATCHED; items have markup.  Every package is checked against the one it was made from, and is no result unless all CHECKS hold."""
    if failed and not best_effort:
        return path, None, 0, failed, f"atomic conversion stopped: {len(failed)} formula(s) could not be converted"
    edits: dict = {}
    try:
        for x in items:  # may be read once only
            edits.setdefault((x["part"], x["paragraph_index"]), []).append((x["start"], x["end"], x["markup"], x["display"]))
        data, n, warnings = patch(content, edits, best_effort)
        broken = [c for c, holds in checked(content, data, n).items() if not holds]
        if broken:
            return path, None, 0, failed + warnings, f"output failed: {', '.join(broken)}"
        if n == 0 and (edits or failed):
            return path, None, 0, failed + warnings, "no selected formula could be converted safely"
        return path, data, n, failed + warnings, None
    except Exception as e:  # noqa: BLE001  one package's fault
        return path, None, 0, failed, str(e)


def patched(packages: DataFrame, items: DataFrame, compiler: Callable[[str], bytes], best_effort: bool = False) -> DataFrame:
    """packages (path, content), items (path, part, paragraph_index, start, end, normalized, display) -> PATCHED, for packages that are rows already.

    A failure concerns its package alone.  compiler: TeX to Office Math markup; it sees each distinct formula of a package once.
    """
    edits = items.groupBy("path").agg(F.collect_list(F.struct("part", "paragraph_index", "start", "end", "normalized", "display")).alias("items"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content, own in zip(pdf["path"], pdf["content"], pdf["items"]):
                made, failed, known = [], [], {}
                for x in own if own is not None else []:
                    tex = x["normalized"]
                    if tex not in known:
                        try:
                            known[tex] = compiler(tex)
                        except Exception as e:  # noqa: BLE001  one formula's fault
                            known[tex] = None
                            failed.append(f"PANDOC_FORMULA_FAILED: {tex}: {e}")
                    if known[tex] is not None:
                        made.append({**x, "markup": known[tex]})
                rows.append(_patched(path, content, made, failed, best_effort))
            yield pd.DataFrame(rows, columns=["path", "content", "converted", "warnings", "error"])

    return packages.join(edits, "path", "left").mapInPandas(run, PATCHED)


def patched_in_place(paths: DataFrame, items: DataFrame, made: DataFrame, best_effort: bool = False, tasks: int = 1) -> DataFrame:
    """paths (path), items (path, part, paragraph_index, start, end, display, formula), made (formula, markup, warning) -> PATCHED.

    Only edits are shuffled, a package's to one row; the task that has them reads the package from the store.  Markup goes to a package once
    for each of its formulas, so neither does a common formula meet all of its places in one task, nor is its markup copied to each.  A formula
    without markup has failed, and says so in its warning, once for each place.  tasks: over how many packages are dealt out at least, as edits
    are few bytes for the work they make.
    """
    names = ("part", "paragraph_index", "start", "end", "display", "formula")
    deal = lambda df: df.repartition(tasks, "path")
    edits = deal(items).groupBy("path").agg(F.collect_list(F.struct(*names)).alias("items"))
    known = deal(items.select("path", "formula").distinct().join(made, "formula")).groupBy("path").agg(F.collect_list(F.struct("formula", "markup", "warning")).alias("made"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from glyphmill.sources.word import store_of

        def columns(value: pa.ListScalar, *fields: str) -> Iterator[tuple]:
            return zip(*(value.values.field(f).to_pylist() for f in fields)) if value.is_valid else iter(())

        for b in batches:
            for path, own, formulas in zip(b.column("path").to_pylist(), b.column("items"), b.column("made")):
                markup, failing, failed = {}, {}, []
                for f, m, warning in columns(formulas, "formula", "markup", "warning"):
                    if m is None:
                        failing[f] = warning
                    else:
                        markup[f] = m
                if failing:
                    failed = sorted(failing[f] for (f,) in columns(own, "formula") if f in failing)
                edits = (dict(zip(names, x), markup=markup[x[-1]]) for x in columns(own, *names) if x[-1] in markup)
                store, at = store_of(path)
                try:
                    with store.open_input_file(at) as f:
                        row = _patched(path, f.read(), edits, failed, best_effort)
                except OSError as e:
                    row = (path, None, 0, [], str(e))
                yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, PATCHED_SCHEMA)], schema=PATCHED_SCHEMA)

    return deal(paths.select("path")).join(edits, "path", "left").join(known, "path", "left").mapInArrow(run, PATCHED)


PATCHED_SCHEMA = pa.schema([("path", pa.string()), ("content", pa.binary()), ("converted", pa.int32()), ("warnings", pa.list_(pa.string())), ("error", pa.string())])


def crc(data: bytes) -> int:
    return zlib.crc32(data)


def valid_pdf(content: Column) -> Column:
    """At least 100 bytes, the head of a PDF and its end mark in the last 4,096 bytes."""
    text = F.decode(F.substring(content, -4096, 4096), "ISO-8859-1")
    return (F.octet_length(content) >= 100) & (F.decode(F.substring(content, 1, 5), "ISO-8859-1") == "%PDF-") & F.contains(text, F.lit("%%EOF"))
