"""The include graph: which units a project's main file reaches."""

from __future__ import annotations

import posixpath
import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.functions.text import strip

#: Guards of one project; beyond them the whole project is reported, never cut short.
MOST_FILES, MOST_BYTES = 256, 16 << 20


def resolve(reference: str | None, parent: str, suffix: str = ".tex") -> str | None:
    """A reference of a file, relative to that file's folder; None if it is blank, absolute, has a backslash or leaves the root."""
    raw = (reference or "").strip()
    if not raw or "\\" in raw or raw.startswith("/"):
        return None
    if not posixpath.splitext(posixpath.basename(raw))[1]:
        raw += suffix
    path = posixpath.normpath(posixpath.join(posixpath.dirname(parent), raw))
    return None if path == ".." or path.startswith("../") else path


def resolved(reference: str | Column, parent: str | Column) -> Column:
    """``resolve`` as an expression: the reference's segments are folded onto those of the parent's folder."""
    reference, parent = (F.col(c) if isinstance(c, str) else c for c in (reference, parent))
    raw = strip(reference)
    name = F.element_at(F.split(raw, "/"), -1)
    ends = F.regexp_like(F.regexp_replace(name, r"^\.+", ""), F.lit(r"\."))
    whole = F.concat(F.when(parent.contains("/"), F.regexp_replace(parent, r"(?s)/[^/]*$", "/")).otherwise(""), raw, F.when(ends, "").otherwise(".tex"))
    segments = F.filter(F.split(whole, "/"), lambda x: (x != "") & (x != "."))
    last = lambda out: F.element_at(out, -1)

    def step(out: Column, x: Column) -> Column:
        up = (x == "..") & (F.size(out) > 0) & F.coalesce(F.when(F.size(out) > 0, last(out) != ".."), F.lit(False))
        return F.when(up, F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(x)))

    path = F.aggregate(segments, F.array().cast("array<string>"), step)
    path = F.when(F.size(path) == 0, F.array(F.lit("."))).otherwise(path)
    safe = reference.isNotNull() & (raw != "") & ~raw.contains("\\") & ~raw.startswith("/")
    return F.when(safe & (F.element_at(path, 1) != ".."), F.array_join(path, "/"))


def edge_findings(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges (project, src, dst, line) whose target is no node."""
    return edges.join(nodes.select("project", F.col("node").alias("dst")).distinct(), ["project", "dst"], "left_anti")


#: Frontiers that are read one by one before they are written together.
TOGETHER = 16


def visited(roots: DataFrame, edges: DataFrame, nodes: DataFrame, most_files: int | None = None) -> DataFrame:
    """(project, node, depth, path): nodes reached from roots (project, node), in the order of (depth, path) as a queue visits them.

    edges: (project, src, dst, pos), pos being an include's place in its source.  A node's path holds the places of the includes that lead
    to it first: of its shortest ways the one that compares least, which is the way on which a queue meets it.  One round for each depth, over all
    projects at once; paths are minima that are combined before the shuffle, so neither a project nor a node is a window of its own.
    Edges are written once, each round's new nodes once.  Nodes seen before are taken out, so cycles end.  A project with more than
    ``most_files`` nodes goes no further, and is not cut back: ``guarded`` reports it.
    """
    valid = short(edges.join(nodes.select("project", F.col("node").alias("dst")).distinct(), ["project", "dst"]).groupBy("project", "src", "dst").agg(F.min("pos").alias("pos")))
    none = F.array().cast("array<long>")
    rounds = [short(roots.select("project", "node").distinct().select("project", "node", F.lit(0).alias("depth"), none.alias("path")))]
    depth = 0
    while True:
        depth += 1
        seen = reduce(DataFrame.unionByName, rounds)
        frontier = rounds[-1]
        if most_files is not None:
            full = seen.groupBy("project").agg(F.count("*").alias("n")).where(F.col("n") > most_files)
            frontier = frontier.join(full, "project", "left_anti")
        way = F.concat("path", F.array(F.col("pos").cast("long")))
        step = frontier.select("project", F.col("node").alias("src"), "path").join(valid, ["project", "src"]).select("project", F.col("dst").alias("node"), way.alias("path"))
        new = step.groupBy("project", "node").agg(F.lit(depth).alias("depth"), F.min("path").alias("path")).join(seen.select("project", "node"), ["project", "node"], "left_anti")
        new = short(new)
        if new.isEmpty():
            return seen
        rounds = [short(seen), new] if len(rounds) >= TOGETHER else [*rounds, new]


def closure(roots: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(project, node, depth): nodes reached from roots, with the least number of includes; edges without places."""
    return visited(roots, edges.withColumn("pos", F.lit(0)), nodes).drop("path")


def guarded(units: DataFrame) -> DataFrame:
    """units (project, file, text, depth, path) of ``visited`` -> (project, error) of projects beyond the guards, by the first guard that the visit meets.

    Which comes first is told by running sums in the order of the visit; only projects that break a guard have such a window, and of their
    files only the first MOST_FILES + 1 are in it.
    """
    sums = units.groupBy("project").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).where((F.col("n") > MOST_FILES) | (F.col("bytes") > MOST_BYTES))
    rows = units.select("project", "depth", "path", "file", F.octet_length("text").alias("bytes")).join(sums.select("project"), "project")
    order = Window.partitionBy("project").orderBy("depth", "path", "file")
    rows = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= MOST_FILES + 1)
    running = F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0))
    error = F.when(F.col("place") > MOST_FILES, TOO_MANY).when(running > MOST_BYTES, TOO_LARGE)
    broken = rows.withColumn("error", error).where("error is not null")
    return broken.groupBy("project").agg(F.min_by("error", "place").alias("error"))


TOO_MANY, TOO_LARGE = "too many source files", "source exceeds the safety limit"


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only where all runs on one machine is one of our own set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def short(df: DataFrame) -> DataFrame:
    """df written to the shared folder, so that its plan is short and a lost executor costs no earlier work."""
    folder = shared_dir(df.sparkSession)
    if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def dealt(rows: DataFrame, each: int, *keys: str | Column) -> DataFrame:
    """rows by the hash of keys in tasks of about so many each: small files of many rows are one split, however much work a row is.

    Rows are counted first, which for files with counts in their footers reads no more than those.
    """
    return rows.repartition(max(1, -(-rows.count() // each)), *keys)


def size_guard(units: DataFrame) -> DataFrame:
    """(project, error) of projects beyond the guards."""
    sums = units.groupBy("project").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    error = F.when(F.col("n") > MOST_FILES, F.lit(TOO_MANY)).when(F.col("bytes") > MOST_BYTES, F.lit(TOO_LARGE))
    return sums.withColumn("error", error).where("error is not null").select("project", "error")
