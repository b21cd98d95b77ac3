"""Formula candidates of paragraphs, and what reports and reviews do with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.detection import candidate_spans
from glyphmill.functions.repairing import repaired
from glyphmill.functions.text import strip


def detected(paragraphs: DataFrame, mode: str = "balanced") -> DataFrame:
    """paragraphs (doc, part, paragraph_index, text) -> candidates, without repairs.

    Spans of a paragraph are one array, so its ordinals need no window and no shuffle.  Ids carry the ordinal; in safe mode, and
    for a damaged paragraph, the span.
    """
    spans = paragraphs.where(strip(F.col("text")) != "").select("doc", "part", "paragraph_index", "text", F.posexplode(candidate_spans(F.col("text"), mode)).alias("ordinal", "s"))
    by_span = (F.col("s.kind") == "latex-broken") | F.lit(mode == "safe")
    ids = F.when(by_span, F.concat_ws(":", "part", "paragraph_index", "s.start", "s.end")).otherwise(F.concat_ws(":", "part", "paragraph_index", "ordinal"))
    source = F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    return spans.select("doc", "part", "paragraph_index", "s.*", source.alias("source"), ids.alias("candidate_id"))


def candidates(paragraphs: DataFrame, mode: str = "balanced") -> DataFrame:
    rows = detected(paragraphs, mode).withColumn("plain", F.col("kind").isin("unicode-math", "plain-equation"))
    return repaired(rows, "source", "plain").drop("plain").withColumn("enabled", F.lit(True))


def decided(decisions: DataFrame, *keys: str) -> DataFrame:
    """decisions (keys, enabled, override), one for each key: of repeated ones an opt-out stands, and the last override that is not blank."""
    text = strip(F.col("override"))
    return decisions.groupBy(*keys).agg(F.bool_and(F.coalesce("enabled", F.lit(True))).alias("enabled"), F.max(F.when(text != "", text)).alias("override"))


def reviewed(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions (doc, candidate_id, enabled, override): opt-outs, and overrides that are not blank, of one document's candidates; the first override is recorded once."""
    joined = rows.drop("enabled").join(decided(decisions, "doc", "candidate_id"), ["doc", "candidate_id"], "left")
    edited = F.col("override").isNotNull()
    text = F.coalesce("override", "normalized")
    notes = F.when(edited, F.array_union("repairs", F.array(F.lit("edited in preview")))).otherwise(F.col("repairs"))
    return joined.withColumns({"normalized": text, "repairs": notes, "enabled": F.coalesce("enabled", F.lit(True))}).drop("override")


def compiled(rows: DataFrame, formulas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with `compiled`, warnings): formulas (normalized, compiled) holds each distinct formula once, so a formula is compiled once however often it stands."""
    key = rows.withColumn("_key", strip(F.col("normalized")))
    known = formulas.select(F.col("normalized").alias("_key"), "compiled").dropDuplicates(["_key"])
    return key.join(known, "_key").drop("_key"), key.join(known, "_key", "left_anti").select("part", "paragraph_index", F.lit("PANDOC_FORMULA_FAILED").alias("code"), F.col("normalized").alias("formula"))


def distinct_formulas(rows: DataFrame) -> DataFrame:
    return rows.select(strip(F.col("normalized")).alias("normalized")).distinct()


def counters(rows: DataFrame) -> DataFrame:
    """Report counters of each document."""
    return rows.groupBy("doc").agg(F.count("*").alias("detected"), F.count_if(F.size("repairs") > 0).alias("repaired"), F.count_if("enabled").alias("selected"), F.count_if(~F.col("enabled")).alias("skipped"))


REPORT = ("scanned_parts", "scanned_paragraphs", "already_native", "detected", "repaired", "converted", "skipped")


def report(scan: DataFrame, rows: DataFrame, results: DataFrame) -> DataFrame:
    """(doc, REPORT, error) of each package: scan of ``package.scanned``, rows its reviewed candidates, results of its repair; skipped are opt-outs and unsafe spans."""
    parts = scan.groupBy(F.col("path").alias("doc")).agg(F.count("part").alias("scanned_parts"), F.sum(F.size("texts")).alias("scanned_paragraphs"), F.sum("native").alias("already_native"))
    unsafe = F.size(F.filter("warnings", lambda w: w.startswith("UNSAFE_WORD_STRUCTURE")))
    done = results.select(F.col("path").alias("doc"), F.col("converted").cast("long"), unsafe.cast("long").alias("unsafe"), "error")
    both = parts.join(counters(rows), "doc", "left").join(done, "doc", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    skipped = zero(F.col("skipped")) + zero(F.col("unsafe"))
    return both.select("doc", "scanned_parts", "scanned_paragraphs", "already_native", zero(F.col("detected")).alias("detected"), zero(F.col("repaired")).alias("repaired"), zero(F.col("converted")).alias("converted"), skipped.alias("skipped"), "error")


def by_part(rows: DataFrame) -> DataFrame:
    """Candidates of each paragraph as one ordered array: what an edit of that paragraph needs."""
    return rows.groupBy("doc", "part", "paragraph_index").agg(F.array_sort(F.collect_list(F.struct("start", "end", "normalized"))).alias("items"))


def atomic(rows: DataFrame, failed: DataFrame) -> DataFrame:
    """Rows of documents of which no formula failed."""
    return rows.join(failed.select("doc").distinct(), "doc", "left_anti")


def text_kept(before: Column, after: Column, spans: Column) -> Column:
    """Whether a paragraph's text after an edit is the text before it without the spans."""
    from glyphmill.functions.text import splice

    return after == splice(before, F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("").alias("after"))))
