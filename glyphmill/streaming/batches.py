"""Folders of Word packages and TeX files, repaired as they arrive.

A file stream finds what is new; what has changed under its name, which a file stream takes as seen, a recheck of the whole folder finds.  Each micro-batch is published in two phases, and a row for each of its files goes to a
status table under a name made of its paths and digests, so a batch that is run again replaces its rows.  A file whose path and digest the table holds as completed is
not repaired again, whatever the stream's checkpoint says, so a rerun repairs nothing twice.  A file that can't be repaired is a failed row,
and others go on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill import api
from glyphmill.operators import compiling, graph, latex, reports
from glyphmill.sources import word

#: Files of a micro-batch, at most; their names go through the driver.
AT_ONCE = 1000
NAMES = "*.{docx,docm,tex,DOCX,DOCM,TEX}"
STATUS = "path string, digest string, kind string, status string, converted int, n_warnings int, error string"


def _tex(rows: DataFrame) -> DataFrame:
    """rows (path, content) of TeX files -> (path, content, converted, warnings, error); each file is a unit of its own."""
    units = rows.select(F.col("path").alias("project"), F.lit(0).cast("long").alias("seq"), F.lit(True).alias("is_main"), F.col("path").alias("file"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    done = latex.applied(units, latex.changes(units).withColumn("enabled", F.lit(True)))
    fits = F.col("error").isNull()
    return done.select(F.col("file").alias("path"), F.when(fits, F.encode("output", "UTF-8")).alias("content"), F.col("n_applied").alias("converted"), F.array().cast("array<string>").alias("warnings"), "error")


def completed(spark: SparkSession, status: str) -> DataFrame:
    """The status table, as far as it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(status)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], STATUS)
    return spark.read.schema(f"{STATUS}, batch string").parquet(status).drop("batch")


def repair_arrivals(
    spark: SparkSession, source: str, target: str, status: str, checkpoint: str, compiler: Callable[[str], bytes] | None = None, batch_compiler: compiling.Compiler | None = None,
    best_effort: bool = False, mode: str = "balanced", at_once: int = AT_ONCE, recheck: bool = False,
) -> DataFrame:
    """Repairs what is in a folder and returns the status table; run again, it repairs what is new and, with recheck, what has changed or failed."""
    source = source.rstrip("/")
    if compiler is None and batch_compiler is None:
        raise api.NotAvailable("repair of packages needs a compiler from TeX to Office Math")

    def batch(rows: DataFrame, _: int) -> None:
        name = F.element_at(F.split("path", "/"), -1)
        rows = rows.select(F.concat(F.lit(f"{source}/"), name).alias("path"), F.sha2("content", 256).alias("digest"), reports.file_kind(F.col("path")).alias("kind"))
        before = completed(spark, status).where("status = 'completed'").select("path", "digest").distinct()
        todo = graph.short(rows.where("kind is not null").join(before, ["path", "digest"], "left_anti"))
        own = sorted(todo.select("path", "digest", "kind").collect())  # at most at_once, or what a recheck finds
        names = {kind: [r.path.rpartition("/")[2] for r in own if r.kind == kind] for kind in ("word", "tex")}
        found = []
        if names["word"]:
            found.append(api.repair_words(spark, source, compiler, best_effort=best_effort, mode=mode, batch_compiler=batch_compiler, only=names["word"]))
        if names["tex"]:
            files = spark.read.format("binaryFile").load([f"{source}/{word.escaped(n)}" for n in names["tex"]])
            found.append(_tex(files.select(F.concat(F.lit(f"{source}/"), name).alias("path"), "content")))
        if not found:
            return
        done = word.publish(found[0] if len(found) == 1 else found[0].unionByName(found[1]), target, overwrite=True)
        ends = done.select(F.concat(F.lit(f"{source}/"), "file").alias("path"), "published", "converted", F.size("warnings").alias("n_warnings"), "error")
        table = todo.join(ends, "path", "left").select("path", "digest", "kind", F.when(F.col("published"), "completed").otherwise("failed").alias("status"), F.coalesce("converted", F.lit(0)).alias("converted"), F.coalesce("n_warnings", F.lit(0)).alias("n_warnings"), "error")
        table.write.mode("overwrite").parquet(f"{status.rstrip('/')}/batch={hashlib.md5(repr([tuple(r) for r in own]).encode()).hexdigest()}")

    arrivals = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", NAMES).option("maxFilesPerTrigger", at_once).load(source)
    arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    if recheck:
        batch(spark.read.format("binaryFile").option("pathGlobFilter", NAMES).load(source), -1)
    return completed(spark, status)


def summary(table: DataFrame) -> DataFrame:
    """``reports.batch_summary`` over the last state of each file."""
    last = table.groupBy("path").agg(F.max_by("status", F.col("status") == "completed").alias("status"), F.max("n_warnings").alias("n_warnings"), F.min("error").alias("error"))
    return reports.batch_summary(last.withColumnRenamed("path", "doc"))
