"""Entry points: ``scan`` and ``repair`` over folders of packages and LaTeX projects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions.text import strip
from glyphmill.operators import candidates as cand
from glyphmill.operators import compiling, graph, latex, logs, package, plugins
from glyphmill.sources import files, word

API_VERSION = "2.0"


class NotAvailable(RuntimeError):
    """A boundary that needs an external program or service, of which none is configured."""


def _parts(spark: SparkSession, folder: str, only: list[str] | None = None, **options: str) -> DataFrame:
    """Parts of a folder's packages, or of those with some names, which the source opens alone."""
    parts = word.read_parts(spark, folder, **options)
    return parts if only is None else parts.where(F.col("path").isin(*(f"{folder.rstrip('/')}/{name}" for name in only)))


def _scanned(spark: SparkSession, folder: str, only: list[str] | None = None) -> DataFrame:
    return package.scanned(_parts(spark, folder, only))


def _candidates(scan: DataFrame, mode: str) -> DataFrame:
    texts = scan.where("error is null").select(F.col("path").alias("doc"), "part", F.posexplode("texts").alias("paragraph_index", "text"))
    return cand.candidates(texts, mode)


def scan_words(spark: SparkSession, folder: str, mode: str = "balanced") -> DataFrame:
    """Candidates of every package of a folder that is admitted."""
    return _candidates(_scanned(spark, folder), mode)


def prepared_words(spark: SparkSession, folder: str, mode: str = "balanced", only: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(parts, candidates) of a folder's packages, written to the shared folder, for ``repair_words`` and ``words_report`` to take as prepared: each package is read and searched once."""
    scan = graph.short(_scanned(spark, folder, only))
    return scan, graph.short(_candidates(scan, mode))


def word_findings(spark: SparkSession, folder: str) -> DataFrame:
    """(path, part, code, message): packages that are refused, and parts of others that can't be read."""
    found = _scanned(spark, folder).where("error is not null")
    whole, cut = F.col("part").isNull(), F.split("error", ": ", 2)
    return found.select("path", F.coalesce("part", F.lit("")).alias("part"), F.when(whole, "PACKAGE_REFUSED").otherwise(cut[0]).alias("code"), F.when(whole, F.col("error")).otherwise(F.element_at(cut, -1)).alias("message"))


def repair_words(
    spark: SparkSession, folder: str, compiler: Callable[[str], bytes] | None = None, decisions: DataFrame | None = None, best_effort: bool = False, mode: str = "balanced",
    batch_compiler: compiling.Compiler | None = None, seconds: float = compiling.BATCH_SECONDS, total: float = compiling.TOTAL_SECONDS, only: list[str] | None = None,
    prepared: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """(path, content, converted, warnings, error) of a folder's packages; the compiler, of single formulas or of batches, makes Office Math of TeX.

    decisions: (doc, candidate_id, enabled, override), doc being a package's path.  A formula is compiled once, however many packages hold
    it; packages are read where they are, and no shuffle holds their bytes.  only: names of the packages that are meant.  prepared: what ``prepared_words`` made of the same ones.  Packages that are refused are never unpacked; their reason is the error.
    """
    if compiler is None and batch_compiler is None:
        raise NotAvailable("repair of packages needs a compiler from TeX to Office Math")
    rows = prepared[1] if prepared else _candidates(_scanned(spark, folder, only), mode)
    rows = cand.reviewed(rows, decisions) if decisions is not None else rows
    rows = graph.short(rows.where("enabled").withColumn("formula", strip(F.col("normalized"))).select(F.col("doc").alias("path"), "part", "paragraph_index", "start", "end", "display", "formula"))
    made = graph.short(compiling.compiled(rows.select(F.col("formula").alias("normalized")), batch_compiler or compiling.one_by_one(compiler), seconds=seconds, total=total))
    made = made.withColumnRenamed("normalized", "formula").select("formula", "markup", F.when(F.col("markup").isNull(), F.concat_ws(": ", "code", "formula", "message")).alias("warning"))
    # two relations, as filters are pushed into one relation once a query
    refused, admitted = (_parts(spark, folder, only, content="false").where(f"part is {x}") for x in ("null", "not null"))
    tasks = admitted.rdd.getNumPartitions()  # one of a few large packages each, where hashes don't meet
    done = package.patched_in_place(admitted.select("path").distinct(), rows, made, best_effort, max(tasks, min(4 * tasks, 200)))
    return done.unionByName(refused.select("path", F.lit(None).cast("binary").alias("content"), F.lit(0).alias("converted"), F.array().cast("array<string>").alias("warnings"), "error"))


def publish_words(spark: SparkSession, folder: str, target: str, overwrite: bool = False, **options) -> DataFrame:
    """Repaired copies of a folder's packages in another folder, all or none; returns (file, published, converted, warnings, error) of each."""
    if target.rstrip("/") == folder.rstrip("/"):
        raise ValueError("packages are never overwritten in place")
    return word.publish(repair_words(spark, folder, **options), target, overwrite)


def words_report(spark: SparkSession, folder: str, results: DataFrame, decisions: DataFrame | None = None, mode: str = "balanced", prepared: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The seven counters of each package (``candidates.REPORT``); results of repair_words or publish_words, prepared of ``prepared_words``."""
    scan = prepared[0] if prepared else _scanned(spark, folder)
    rows = prepared[1] if prepared else _candidates(scan, mode)
    if "path" not in results.columns:
        results = results.withColumn("path", F.concat(F.lit(folder.rstrip("/") + "/"), "file"))
    return cand.report(scan, cand.reviewed(rows, decisions) if decisions is not None else rows, results)


def scan_project(spark: SparkSession, root: str, main: str = "main.tex", profile: str = "generic", registry: plugins.Registry | None = None, adapter: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(changes, findings) of the units that a project's main file reaches, in the order in which includes are met; findings in order.

    A project beyond the guards has one finding that says so.
    """
    if profile not in plugins.PROFILES:
        raise ValueError(f"unknown profile: {profile}")
    units, includes, guard = files.workspace(files.read_tex(spark, root, main=main))
    own = units.select("project").distinct()
    beside = main.rpartition("/")[0]
    there = files.listed(spark, root).withColumn("project", F.lit("p"))
    styles = there.where(F.regexp_extract("file", r"(?s)^(?:(.*)/)?[^/]*$", 1) == beside)
    needed = there.where(F.col("file").isin(*(adapter or {}).get("required_files", []))).join(own, "project").select("project", "file", F.lit(None).cast("string").alias("text"))
    found = latex.all_findings(
        units, latex.bib_keys(files.bibliographies(spark, root, units)),
        latex.template_missing(own.withColumn("profile", F.lit(profile)), styles), includes,
        logs.findings(files.read_log(spark, root, main).join(guard, "project", "left_anti"), main.rpartition("/")[2]),
        registry.findings(units, {"thesis_profile": profile}) if registry else None,
        plugins.adapter_findings(units.select("project", "file", "text").unionByName(needed), adapter) if adapter else None,
    )
    rows = found.orderBy("stage", "step", "seq", "pos").select("code", "message", "suggestion", "severity", "file", "line", "plugin")
    large = guard.select(F.lit("PROJECT_TOO_LARGE").alias("code"), F.col("error").alias("message"), F.lit("").alias("suggestion"), F.lit("error").alias("severity"), F.lit("").alias("file"), F.lit(None).cast("int").alias("line"), F.lit("").alias("plugin"))
    return latex.changes(units), rows.unionByName(large)


def repair_project(spark: SparkSession, root: str, target: str, main: str = "main.tex", decisions: DataFrame | None = None) -> int:
    """A repaired copy of a project; returns how many units it wrote.  A project beyond the guards is refused, and nothing is written."""
    units, _, guard = files.workspace(files.read_tex(spark, root, main=main))
    if refused := guard.first():
        raise ValueError(f"{root}: {refused.error}")
    changes = latex.changes(units)
    changes = latex.reviewed(changes, decisions) if decisions is not None else changes.withColumn("enabled", F.lit(True))
    return files.publish_project(root, target, latex.applied(units, changes))


def doctor(spark: SparkSession) -> dict[str, str]:
    import sys

    import pyarrow

    return {"spark": spark.version, "python": sys.version.split()[0], "pyarrow": pyarrow.__version__, "compiler": "not configured", "pdf": "not configured"}
