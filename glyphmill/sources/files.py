"""LaTeX projects and review files as relations, and sinks for what was repaired."""

from __future__ import annotations

import io
import json
import os
import shutil
import uuid
import zipfile
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.operators import graph, latex, logs
from glyphmill.operators.reports import base_name
from glyphmill.sources.word import escaped

#: Limits of bundles and their files; what publishing leaves out.
MOST_REPORT, MOST_SOURCES, MOST_SOURCE = 32 << 20, 20, 64 << 20
IGNORED = shutil.ignore_patterns(".git", ".venv", "__pycache__", "*.aux", "*.toc")


def read_tex(spark: SparkSession, root: str, project: str = "p", main: str = "main.tex") -> DataFrame:
    """units of all .tex files under a folder: (project, seq, is_main, file, text); bytes that are no UTF-8 become U+FFFD."""
    base = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tex").option("recursiveFileLookup", "true").load(root)
    file = F.substring_index("path", base, -1)
    rows = files.select(F.lit(project).alias("project"), file.alias("file"), F.decode(F.try_validate_utf8(F.col("content").cast("string")).cast("binary"), "UTF-8").alias("text"), F.col("content"))
    rows = rows.withColumn("text", F.coalesce("text", F.make_valid_utf8(F.col("content").cast("string")))).drop("content")
    return rows.select("project", F.xxhash64("file").alias("seq"), (F.col("file") == main).alias("is_main"), "file", "text")


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, file) of all files under a folder, without their content."""
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    return paths.withColumn("file", F.substring_index("path", root.rstrip("/") + "/", -1))


def bibliographies(spark: SparkSession, root: str, units: DataFrame, project: str = "p") -> DataFrame:
    """(project, text) of the bibliographies that a project's units declare and that are there; if there are none, of every .bib under the folder."""
    found = latex.declared_bibliographies(units).select("value", "file").collect()
    wanted = {graph.resolve(r.value, r.file, ".bib") for r in found} - {None}
    paths = [escaped(r.path) for r in listed(spark, root).where(F.col("file").isin(*wanted)).collect()] if wanted else []
    reader = spark.read.format("binaryFile")
    bibs = reader.load(paths) if paths else reader.option("pathGlobFilter", "*.bib").option("recursiveFileLookup", "true").load(root)
    return bibs.select(F.lit(project).alias("project"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def read_log(spark: SparkSession, root: str, main: str, project: str = "p") -> DataFrame:
    """logs (project, seq, text) of the compile log beside the main file; no rows if there is none."""
    name = main.removesuffix(".tex") + ".log"
    at = [escaped(r.path) for r in listed(spark, root).where(F.col("file") == name).collect()]
    if not at:
        return spark.createDataFrame([], "project string, seq long, text string")
    text = F.make_valid_utf8(F.col("content").cast("string"))
    rows = spark.read.format("binaryFile").load(at).select(F.posexplode(F.udf(lambda t: logs.entries(t), "array<string>")(text)).alias("seq", "text"))
    return rows.select(F.lit(project).alias("project"), F.col("seq").cast("long"), "text")


def include_edges(units: DataFrame) -> DataFrame:
    """(project, src, raw, dst, pos, line): every include with its place among its unit's; dst is null where it is not allowed."""
    found = latex.tokens(units, latex.INCLUDE).withColumnRenamed("value", "raw")
    return found.select("project", F.col("file").alias("src"), "raw", graph.resolved("raw", "file").alias("dst"), "pos", "line")


def workspace(units: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Units that a project's main file reaches, with seq, depth and path in the order of the visit; findings on includes; projects beyond the guards.

    A project beyond a guard has neither units nor findings, but one row (project, error).  seq counts a project's units, of which there are at
    most as many as the guard allows.
    """
    edges = graph.short(include_edges(units))
    nodes = units.select("project", F.col("file").alias("node"))
    reached = graph.visited(units.where("is_main").select("project", F.col("file").alias("node")), edges.where("dst is not null").select("project", "src", "dst", "pos"), nodes, graph.MOST_FILES)
    own = units.drop("seq").join(reached.withColumnRenamed("node", "file"), ["project", "file"])
    guard = graph.short(graph.guarded(own))
    place = F.row_number().over(Window.partitionBy("project").orderBy("depth", "path")) - 1
    order = reached.join(guard, "project", "left_anti").select("project", F.col("node").alias("file"), "depth", "path", place.cast("long").alias("seq"))
    kept = units.drop("seq").join(order, ["project", "file"])
    found = edges.join(order.select("project", F.col("file").alias("src"), "seq"), ["project", "src"])
    gone = found.where("dst is not null").join(nodes.select("project", F.col("node").alias("dst")).distinct(), ["project", "dst"], "left_anti")
    quoted = lambda a, b: F.concat(F.lit(a), "raw", F.lit(b))
    row = lambda rows, code, message, suggestion: rows.select("project", "seq", "pos", F.lit(code).alias("code"), message.alias("message"), F.lit(suggestion).alias("suggestion"), F.lit("error").alias("severity"), F.col("src").alias("file"), "line")
    unsafe = row(found.where("dst is null"), "UNSAFE_INCLUDE", quoted("Include path '", "' is absolute, malformed, or leaves the project root."), "Keep included TEX files inside the project folder and use a relative path.")
    missing = row(gone, "MISSING_INCLUDE", quoted("Included file '", "' was not found."), "Restore the file or correct the \\input/\\include path.")
    return kept, unsafe.unionByName(missing), guard


def read_review(path: str) -> dict:
    if os.path.getsize(path) > MOST_REPORT:
        raise ValueError("report is too large")
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    if not isinstance(data, dict):
        raise ValueError("report must be an object")
    return data


def write_units(units: DataFrame, root: str) -> int:
    """Writes each unit's output below root, each file whole or not at all; returns how many.  root is a folder that all executors share."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for file, text in zip(pdf["file"], pdf["output"]):
                path = os.path.join(root, file)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                temp = f"{path}.{uuid.uuid4().hex}"
                with open(temp, "w", encoding="utf-8", newline="") as f:
                    f.write(text)
                os.replace(temp, path)
            yield pd.DataFrame({"n": [len(pdf)]})

    return units.select("file", "output").mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def publish_project(source: str, target: str, units: DataFrame) -> int:
    """A project's copy with repaired units: staged beside the target, then swapped in; the old target comes back if that fails.

    A project with a unit whose changes do not fit (`error`) is not published.
    """
    if "error" in units.columns and (misfit := units.where("error is not null").select("file", "error").orderBy("file").first()):
        raise ValueError(f"{misfit.file}: {misfit.error}")
    stage, old = f"{target}.{uuid.uuid4().hex}.new", f"{target}.{uuid.uuid4().hex}.old"
    shutil.copytree(source, stage, ignore=IGNORED)
    try:
        n = write_units(units, stage)
        had = os.path.exists(target)
        if had:
            os.replace(target, old)
        try:
            os.replace(stage, target)
        except OSError:
            if had:
                os.replace(old, target)
            raise
        shutil.rmtree(old, ignore_errors=True)
        return n
    finally:
        shutil.rmtree(stage, ignore_errors=True)


def review_bundle(report: dict, sources: list[str] = (), consent: bool = False) -> bytes:
    """A bundle of a manifest and a report whose paths are cut to names; sources only with consent, within the limits."""
    clean = {k: (os.path.basename(v.replace("\\", "/")) if k.endswith("_path") and isinstance(v, str) else v) for k, v in report.items()}
    if sources and not consent:
        raise ValueError("sources need consent")
    if len(sources) > MOST_SOURCES or any(os.path.getsize(s) > MOST_SOURCE for s in sources):
        raise ValueError("too many or too large sources")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("manifest.json", json.dumps({"created_at": datetime.now(timezone.utc).isoformat(), "includes_sources": bool(sources)}))
        z.writestr("report.json", json.dumps(clean, ensure_ascii=False))
        for s in sources:
            z.write(s, f"sources/{os.path.basename(s)}")
    return out.getvalue()


__all__ = ["base_name", "include_edges", "publish_project", "read_review", "read_tex", "review_bundle", "workspace", "write_units"]
