"""Diagnostics of LaTeX projects.  Input: units (project, seq, is_main, file, text); output: findings or changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.text import count_of, line_at, matches, splice, strip
from glyphmill.operators import graph

#: Patterns of tokens.
CITE = r"\\(?:cite|parencite|textcite|autocite)\*?(?:\[[^]]*\]){0,2}\{([^}]+)\}"
REF = r"\\(?:ref|eqref|autoref)\{([^}]+)\}"
LABEL = r"\\label\{([^}]+)\}"
BIB_ENTRY = r"(?iU)@\w+\s*\{\s*([^,\s]+)"
INCLUDE = r"(?U)\\(?:input|include|subfile)\s*\{([^}]+)\}"
BIBLIOGRAPHY = r"(?U)\\bibliography\s*\{([^}]+)\}"
BIB_RESOURCE = r"(?U)\\addbibresource(?:\[[^]]*\])?\s*\{([^}]+)\}"
#: Fractions without braces or without a backslash, with the reason of the change.
ATOM = r"(\\[A-Za-z]+|[A-Za-z0-9])"
FRACTIONS = (
    (r"\\frac\s*" + ATOM + r"\s*" + ATOM, "Missing braces around fraction arguments"),
    (r"(?<![\\A-Za-z])frac\s*" + ATOM + r"\s*" + ATOM, "Missing backslash and braces in fraction command"),
)
#: What asks for a package, the package, the command.
HINTS = (
    ("\\begin{align", "amsmath", "\\usepackage{amsmath}"),
    ("\\includegraphics", "graphicx", "\\usepackage{graphicx}"),
    ("\\mathbb", "amssymb", "\\usepackage{amssymb}"),
)
PERSIAN = r"[\u0600-\u06ff]"
#: Findings on right-to-left sources, in order.
PERSIAN_RULES = (
    ("PERSIAN_PACKAGE", "Persian text detected but xepersian is not loaded.", "\\usepackage{xepersian}", "\\usepackage{xepersian}", None),
    ("PERSIAN_FONT", "No Persian main font is configured.", "\\settextfont{Vazirmatn}", "\\settextfont", None),
    ("LATIN_FONT", "No Latin companion font is configured.", "\\setlatintextfont{TeX Gyre Termes}", "\\setlatintextfont", None),
    ("BIDI_ENV", "An unclosed latin environment may break bidirectional layout.", "\\end{latin}", "\\end{latin}", "\\begin{latin}"),
)


def tokens(units: DataFrame, pattern: str, split_commas: bool = False) -> DataFrame:
    """(project, seq, file, start, pos, value, key, line): every occurrence, in order, as written and stripped; empty keys of a comma list are dropped."""
    found = units.select("project", "seq", "file", "text", F.posexplode(matches(F.col("text"), pattern)).alias("pos", "m"))
    rows = found.select("project", "seq", "file", F.col("m.start").alias("start"), "pos", F.col("m.value").alias("value"), line_at(F.col("text"), F.col("m.start")).alias("line"))
    if not split_commas:
        return rows.withColumn("key", strip(F.col("value")))
    return rows.withColumn("key", F.explode(F.split("value", ","))).withColumn("key", strip(F.col("key"))).where("key <> ''")


def bib_keys(bibs: DataFrame) -> DataFrame:
    """bibs (project, text) -> distinct (project, key)."""
    return bibs.select("project", F.explode(F.regexp_extract_all("text", F.lit(BIB_ENTRY), F.lit(1))).alias("key")).distinct()


def declared_bibliographies(units: DataFrame) -> DataFrame:
    """Distinct (project, file, value) of declared bibliographies; blank values and those with a backslash are dropped."""
    lists = F.flatten(F.transform(F.regexp_extract_all("text", F.lit(BIBLIOGRAPHY), F.lit(1)), lambda v: F.split(v, ",")))
    values = F.concat(lists, F.regexp_extract_all("text", F.lit(BIB_RESOURCE), F.lit(1)))
    rows = units.select("project", "file", F.explode(values).alias("value")).withColumn("value", strip(F.col("value")))
    return rows.where((F.col("value") != "") & ~F.col("value").contains("\\")).distinct()


def missing(occurrences: DataFrame, available: DataFrame) -> DataFrame:
    """Occurrences whose key is not available in their project: a left anti join."""
    return occurrences.join(available.select("project", "key").distinct(), ["project", "key"], "left_anti")


def repeated(labels: DataFrame) -> DataFrame:
    """Every location of a label that its project defines more than once; counts meet before the join, so one label is no hot task."""
    often = labels.groupBy("project", "key").agg(F.count("*").alias("n")).where("n > 1")
    return labels.join(often, ["project", "key"])


def brace_mismatch(text: Column) -> Column:
    return count_of(text, "{") != count_of(text, "}")


def table_mismatch(text: Column) -> Column:
    n = lambda end: F.regexp_count(text, F.lit(rf"\\{end}\{{(?:tabular|longtable)\}}"))
    return n("begin") != n("end")


def loads_package(source: Column, package: str) -> Column:
    return F.regexp_like(source, F.lit(rf"(?U)\\usepackage(?:\[[^]]*\])?\{{[^}}]*\b{package}\b[^}}]*\}}"))


def _finding(code, message, suggestion, severity: str = "warning") -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(lit(code).alias("code"), lit(message).alias("message"), lit(suggestion).alias("suggestion"), F.lit(severity).alias("severity"))


def unit_findings(units: DataFrame) -> DataFrame:
    """Rules on single units, exploded in order: packages (looked up in the main file), right-to-left rules, braces, tables."""
    loaded = units.where("is_main").select("project", *(loads_package(F.col("text"), p).alias(f"has_{p}") for _, p, _ in HINTS))
    both = units.join(loaded, "project", "left")
    t = F.col("text")
    rules = [F.when(t.contains(token) & ~F.coalesce(F.col(f"has_{p}"), F.lit(False)), _finding("MISSING_PACKAGE", f"{p} appears to be required.", command)) for token, p, command in HINTS]
    persian = F.regexp_like(t, F.lit(PERSIAN))
    for code, message, suggestion, needle, opener in PERSIAN_RULES:
        holds = persian & ~t.contains(needle)
        rules.append(F.when(holds & t.contains(opener) if opener else holds, _finding(code, message, suggestion)))
    rules.append(F.when(brace_mismatch(t), _finding("UNBALANCED_BRACES", "The source file has unbalanced curly braces.", "Review the nearest LaTeX group before compiling.", "error")))
    rules.append(F.when(table_mismatch(t), _finding("TABLE_ENVIRONMENT_MISMATCH", "A tabular/longtable environment is not opened and closed consistently.", "Match every table environment begin/end pair before compiling.", "error")))
    return both.select("project", "seq", "file", F.posexplode(F.array_compact(F.array(*rules))).alias("pos", "f")).select("project", "seq", "file", "pos", "f.*")


def _located(rows: DataFrame, code: str, message: Column, suggestion: Column, step: int) -> DataFrame:
    return rows.select("project", F.lit(step).alias("step"), "seq", F.col("start").alias("pos"), F.lit(code).alias("code"), message.alias("message"), suggestion.alias("suggestion"), F.lit("warning").alias("severity"), "file", "line")


def workspace_findings(units: DataFrame, keys: DataFrame) -> DataFrame:
    """Missing citations, missing references, repeated labels, in this order."""
    labels, key = tokens(units, LABEL), F.col("key")
    cited = missing(tokens(units, CITE, True), keys)
    referenced = missing(tokens(units, REF), labels)
    twice = repeated(labels)
    quoted = lambda a, b: F.concat(F.lit(a), key, F.lit(b))
    return (
        _located(cited, "MISSING_CITATION", quoted("Citation key '", "' was not found in project bibliography files."), quoted("Add a BibTeX entry for ", " or correct the citation key."), 0)
        .unionByName(_located(referenced, "MISSING_REFERENCE", quoted("Reference '", "' has no matching label in the LaTeX project."), quoted("Add \\label{", "} or correct the reference key."), 1))
        .unionByName(_located(twice, "DUPLICATE_LABEL", quoted("Label '", "' is defined more than once."), F.lit("Rename duplicate labels so every reference target is unique."), 2))
    )


def _staged(rows: DataFrame, stage: int | Column, step: int | Column, **columns: Column) -> DataFrame:
    """A relation in the schema of all findings; what it lacks has the default."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    default = {"seq": F.lit(0).cast("long"), "pos": F.lit(0), "suggestion": F.lit(""), "severity": F.lit("warning"), "file": F.lit(""), "line": F.lit(None).cast("int"), "plugin": F.lit("")}
    pick = lambda c: columns.get(c, F.col(c) if c in rows.columns else default.get(c))
    return rows.select("project", lit(stage).alias("stage"), lit(step).alias("step"), *(pick(c).alias(c) for c in ("seq", "pos", "code", "message", "suggestion", "severity", "file", "line", "plugin")))


def all_findings(units: DataFrame, keys: DataFrame, templates: DataFrame | None = None, includes: DataFrame | None = None, log: DataFrame | None = None, plugins: DataFrame | None = None, adapters: DataFrame | None = None) -> DataFrame:
    """One schema for every rule, with (stage, step, seq, pos) as its order: template, units, workspace, log, plugins, load errors.

    templates: of template_missing; includes: of files.workspace; log: of logs.findings; plugins:
    of Registry.findings; adapters: of adapter_findings.  A stage without a relation has no rows.
    """
    found = [_staged(unit_findings(units), 1, 0), _staged(workspace_findings(units, keys), 2, F.col("step") + 1)]
    if templates is not None:
        message = "A university compatibility profile was selected, but no local .cls or .sty template was found."
        suggestion = "Place the licensed or university-provided template beside the TEX project."
        found.append(_staged(templates, 0, 0, code=F.lit("THESIS_TEMPLATE_MISSING"), message=F.lit(message), suggestion=F.lit(suggestion)))
    if includes is not None:
        found.append(_staged(includes, 2, 0))
    if log is not None:
        found.append(_staged(log, 3, F.col("rank"), suggestion=F.coalesce("suggestion", F.lit(""))))
    if plugins is not None:
        late = (F.col("code") == "PLUGIN_LOAD_ERROR") & (F.col("plugin") == "")
        found.append(_staged(plugins, F.when(late, 5).otherwise(4), 0))
    if adapters is not None:
        found.append(_staged(adapters, 4, 1))
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return rows


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with seq: their place among all rows by the columns of `order`.  Rows are dealt out by range, and only the ranges' sizes meet in one place."""
    dealt = graph.short(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_local")))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("n"), F.min("_local").alias("_first"))
    base = sizes.select("_part", "_first", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return dealt.join(base, "_part").withColumn("seq", F.col("_base") + F.col("_local") - F.col("_first")).drop("_part", "_local", "_first", "_base")


def template_missing(projects: DataFrame, files: DataFrame) -> DataFrame:
    """projects (project, profile) that chose a university's profile without a .cls or .sty among files (project, file)."""
    styles = files.where(F.col("file").endswith(".cls") | F.col("file").endswith(".sty")).select("project").distinct()
    return projects.where("profile <> 'generic'").join(styles, "project", "left_anti")


def changes(units: DataFrame) -> DataFrame:
    """Fraction repairs with their place in the project: by unit, pattern, match.  The ordinal is a window over one project."""
    parts = []
    for order, (pattern, reason) in enumerate(FRACTIONS):
        first, second = matches(F.col("text"), pattern, 1), F.regexp_extract_all("text", F.lit(pattern), F.lit(2))
        pairs = F.zip_with(first, second, lambda m, b: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["source"].alias("before"), m["value"].alias("a"), b.alias("b")))
        rows = units.select("project", "seq", "file", "text", F.explode(pairs).alias("m"))
        parts.append(rows.select("project", "seq", "file", F.lit(order).alias("pattern"), "m.start", "m.end", "m.before", F.concat(F.lit("\\frac{"), "m.a", F.lit("}{"), "m.b", F.lit("}")).alias("after"), F.lit(reason).alias("reason"), line_at(F.col("text"), F.col("m.start")).alias("line")))
    rows = parts[0].unionByName(parts[1])
    place = F.row_number().over(Window.partitionBy("project").orderBy("seq", "pattern", "start")) - 1
    return rows.withColumn("change_id", F.concat_ws(":", F.lit("tex"), "file", "line", place))


def reviewed(rows: DataFrame, decisions: DataFrame, key: str = "change_id") -> DataFrame:
    """Opt-outs and overrides: rows with `enabled`, and `after` replaced where an override is not blank."""
    joined = rows.join(decisions, key, "left")
    text = strip(F.col("override"))
    after = F.when(text != "", text).otherwise(F.col("after"))
    return joined.withColumns({"after": after, "enabled": F.coalesce("enabled", F.lit(True))}).drop("override")


def applied(units: DataFrame, rows: DataFrame) -> DataFrame:
    """units with `output`, `n_applied` and `error`: enabled changes spliced left to right.  A unit with a change that overlaps, is stale, blank or
    oversized stays as it is and says so; other units are not concerned."""
    edits = rows.where("enabled").groupBy("project", "file").agg(F.array_sort(F.collect_list(F.struct("start", "end", "before", "after"))).alias("edits"))
    both = units.join(edits, ["project", "file"], "left")
    pairs = F.expr("slice(transform(edits, (e, i) -> struct(e as e, if(i = 0, 0, edits[i - 1].end) as floor)), 1, size(edits))")
    bad = F.exists(pairs, lambda p: (p["e"]["start"] < p["floor"]) | (strip(p["e"]["after"]) == "") | (F.length(p["e"]["after"]) > 100_000))
    stale = F.exists("edits", lambda e: F.substring(F.col("text"), e["start"] + 1, e["end"] - e["start"]) != e["before"])
    error = F.when(F.col("edits").isNull(), F.lit(None)).when(bad, F.lit("changes overlap, are blank or too long")).when(stale, F.lit("the text has changed since it was scanned"))
    both = both.withColumn("error", error.cast("string"))
    fits = F.col("edits").isNotNull() & F.col("error").isNull()
    output = F.when(fits, splice(F.col("text"), F.col("edits"))).otherwise(F.col("text"))
    return both.withColumns({"output": output, "n_applied": F.when(fits, F.size("edits")).otherwise(F.lit(0))}).drop("edits")
