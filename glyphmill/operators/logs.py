"""TeX compile logs: rows (project, seq, text) in order, one entry of the log each."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.text import SPACE, strip

#: Patterns of log entries.
FILE_LINE = r"(?im)^([^:\n]+\.(?:tex|sty|cls)):(\d+):\s*(.+)$"
BLOCK = r"(?m)^! (.+?)\n(?:.*\n){0,3}?l\.(\d+)\s*(.*)$"
UNDEFINED = r"(?i)LaTeX Warning: Reference `([^']+)' .*?input line (\d+)"
FONT = r"(?s)LaTeX Font Warning:\s*(.+?)(?=\n\n|\z)"
OPEN_OR_CLOSE = r"(?i)\((?:\.{0,2}/)?[^()\s]+\.(?:tex|sty|cls)|\)"
HELP, SPELLING = "Review the command and load the package that defines it.", "Check the command spelling and add the required \\usepackage{...} declaration."


def events(logs: DataFrame) -> DataFrame:
    """(project, seq, pos, file): openings (file) and closings (null) in order."""
    found = logs.select("project", "seq", F.posexplode(F.regexp_extract_all("text", F.lit(OPEN_OR_CLOSE), F.lit(0))).alias("pos", "e"))
    return found.withColumn("file", F.when(F.col("e") != ")", F.substring("e", 2, 1 << 20))).drop("e")


def active_files(logs: DataFrame) -> DataFrame:
    """(project, seq, file): the file open before each entry.

    Depths are running sums of openings and closings that never fall below zero (a closing with nothing open counts for nothing).
    The open file is that of the latest opening that led to the depth at hand: had the log been above and below it since, the
    way back up would be a later one.  All of it is running windows over rows of a file name each; no log is held as a whole.
    """
    order = Window.partitionBy("project").orderBy("seq", "pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    moves = events(logs).withColumn("sum", F.sum(F.when(F.col("file").isNotNull(), 1).otherwise(-1)).over(so_far))
    moves = moves.withColumn("depth", F.col("sum") - F.least(F.lit(0), F.min("sum").over(so_far)))
    same = Window.partitionBy("project", "depth").orderBy("seq", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    moves = moves.withColumn("top", F.when(F.col("depth") > 0, F.last("file", ignorenulls=True).over(same)))
    states = moves.select("project", "seq", "pos", F.struct("top").alias("state"))
    rows = states.unionByName(logs.select("project", "seq", F.lit(-1).alias("pos"), F.lit(None).cast("struct<top:string>").alias("state")))
    return rows.withColumn("now", F.last("state", ignorenulls=True).over(so_far)).where("pos = -1").select("project", "seq", F.col("now.top").alias("file"))


def entries(text: str | None) -> list[str]:
    """A log's entries in order: errors and font warnings whole (together where they overlap), other lines one by one."""
    out, at = [], 0
    text = (text or "").replace("\r\n", "\n")
    merged: list[list[int]] = []
    for m in sorted(m.span() for p in (BLOCK, FONT.replace(r"\z", r"\Z")) for m in re.finditer(p, text)):
        if merged and m[0] < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], m[1])
        else:
            merged.append(list(m))
    for start, end in merged:
        out += [*text[at:start].split("\n"), text[start:end]]
        at = end
    return [e for e in [*out, *text[at:].split("\n")] if e]


def findings(logs: DataFrame, main_file: str = "main.tex") -> DataFrame:
    """Errors (by file and line first, each once), undefined references, font warnings."""
    def every(pattern: str, groups: int) -> DataFrame:
        """(project, seq, pos, g1, ...): all matches of each entry."""
        of = [F.regexp_extract_all("text", F.lit(pattern), F.lit(i)).alias(f"g{i}") for i in range(1, groups + 1)]
        return logs.where(F.regexp_like("text", F.lit(pattern))).select("project", "seq", F.posexplode(F.arrays_zip(*of)).alias("pos", "m")).select("project", "seq", "pos", "m.*")

    def found(rows: DataFrame, rank: int, code: str, message: Column, file: Column, line: Column, severity: str) -> DataFrame:
        return rows.select("project", "seq", "pos", F.lit(rank).alias("rank"), F.lit(code).alias("code"), message.alias("message"), file.cast("string").alias("file"), line.cast("int").alias("line"), F.lit(severity).alias("severity"))

    g1, g2, g3, none = F.col("g1"), F.col("g2"), F.col("g3"), F.lit(None)
    direct = found(every(FILE_LINE, 3), 0, "LATEX_COMPILE_ERROR", strip(g3), g1, g2, "error")
    blocks = found(every(BLOCK, 2).join(active_files(logs), ["project", "seq"]), 1, "LATEX_COMPILE_ERROR", strip(g1), F.col("file"), g2, "error")
    first = F.row_number().over(Window.partitionBy("project", "code", "file", "line", "message").orderBy("rank", "seq", "pos"))
    errors = direct.unionByName(blocks).withColumn("n", first).where("n = 1").drop("n")
    undefined = found(every(UNDEFINED, 2), 2, "UNDEFINED_REFERENCE", F.concat(F.lit("Reference '"), g1, F.lit("' is undefined.")), none, g2, "warning")
    fonts = found(every(FONT, 1), 3, "FONT_WARNING", strip(F.regexp_replace(g1, SPACE + "+", " ")), none, none, "warning")
    rows = errors.unionByName(undefined).unionByName(fonts)
    help_ = F.when(F.col("message").contains("Undefined control sequence"), SPELLING).otherwise(HELP)
    return rows.withColumns({"file": F.coalesce("file", F.lit(main_file)), "suggestion": F.when(F.col("code") == "LATEX_COMPILE_ERROR", help_)})
