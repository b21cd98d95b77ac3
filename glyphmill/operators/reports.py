"""Reports: projections for review, counters, JSON and HTML."""

from __future__ import annotations

import html
import json
import os
import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def review_rows(changes: DataFrame) -> DataFrame:
    """changes as candidates, so one report serves both kinds of documents."""
    return changes.select(
        F.col("change_id").alias("candidate_id"), F.col("file").alias("part"), F.greatest(F.lit(0), F.coalesce("line", F.lit(1)) - 1).alias("paragraph_index"), "start", "end",
        F.col("before").alias("source"), F.col("after").alias("normalized"), F.array("reason").alias("repairs"),
    )


def location(file: Column, line: Column) -> Column:
    """file:line, file, line n, or -."""
    named = F.coalesce(file, F.lit("")) != ""
    return F.when(named & line.isNotNull(), F.concat_ws(":", file, line)).when(named, file).when(line.isNotNull(), F.concat(F.lit("line "), line)).otherwise(F.lit("-"))


def reason_text(repairs: Column, enabled: Column, default: str = "Formula detected and normalized") -> Column:
    joined = F.array_join(repairs, "; ")
    return F.when(~enabled, F.lit("Skipped by user")).when(joined == "", F.lit(default)).otherwise(joined)


def batch_summary(statuses: DataFrame) -> DataFrame:
    """statuses (doc, status, n_warnings, error) -> one row of counts and the first error by document."""
    return statuses.agg(
        F.count_if(F.col("status") == "completed").alias("completed"), F.count_if((F.col("status") == "completed") & (F.col("n_warnings") > 0)).alias("with_warnings"),
        F.count_if(F.col("status") == "failed").alias("failed"), F.min_by(F.when(F.col("status") == "failed", F.col("error")), F.when(F.col("status") == "failed", F.col("doc"))).alias("first_error"),
    )


def json_rows(rows: DataFrame, key: str) -> DataFrame:
    """(key, report): each row as JSON."""
    return rows.select(key, F.to_json(F.struct(*(c for c in rows.columns if c != key))).alias("report"))


def translated(keys: DataFrame, messages: DataFrame, lang: str) -> DataFrame:
    """keys (key) -> text in a language, else in English, else the key.  messages (lang, key, text) is a small dimension."""
    own = messages.where(F.col("lang") == lang).select("key", F.col("text").alias("own"))
    base = messages.where("lang = 'en'").select("key", F.col("text").alias("base"))
    return keys.join(own, "key", "left").join(base, "key", "left").select("key", F.coalesce("own", "base", "key").alias("text"))


def file_kind(path: Column) -> Column:
    """word or tex by suffix; null: neither."""
    low = F.lower(path)
    return F.when(low.endswith(".docx") | low.endswith(".docm"), "word").when(low.endswith(".tex"), "tex")


#: Fixed value: characters of a formula that a listing shows.
SHOWN = 90


def shown(source: Column) -> Column:
    return F.substring(source, 1, SHOWN)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/\\]+$", 0)


#: Hosts that plain http may reach: addresses of private, loopback, link-local and documentation networks.
PART = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
NETWORKS = ("0", "10", "127", r"169\.254", r"172\.(?:1[6-9]|2[0-9]|3[01])", r"192\.168", r"192\.0\.0", r"192\.0\.2", r"198\.1[89]", r"198\.51\.100", r"203\.0\.113")
PRIVATE_V4 = rf"^(?={PART}(?:\.{PART}){{3}}$)(?:{'|'.join(NETWORKS)})\."
PRIVATE_V6 = r"^\[(?:::1?|f[cd][0-9a-f]{2}:[0-9a-f:]*|fe[89ab][0-9a-f]:[0-9a-f:]*)\]$"


def endpoint_allowed(url: Column) -> Column:
    """https to any host, http to localhost and private addresses alone, never with credentials."""
    scheme, host = F.lower(F.parse_url(url, F.lit("PROTOCOL"))), F.lower(F.parse_url(url, F.lit("HOST")))
    private = (host == "localhost") | F.regexp_like(host, F.lit(PRIVATE_V4)) | F.regexp_like(host, F.lit(PRIVATE_V6))
    plain = F.parse_url(url, F.lit("USERINFO")).isNull()
    return F.coalesce(plain & ((scheme == "https") | ((scheme == "http") & private)) & host.isNotNull(), F.lit(False))


def free_names(wanted: DataFrame, taken: DataFrame, companions: tuple[str, ...] = ()) -> DataFrame:
    """wanted (dir, stem, suffix) -> (dir, stem, suffix, name): the stem, or with _2, _3, ..., whichever no taken (dir, name) has first, neither with
    the suffix nor with one of companions.

    Suffixes are empty or begin with a dot.  Taken names give the numbers in use, and the first gap is the answer, so there is no limit and
    nothing is tried in vain.
    """
    asked = wanted.select("dir", "stem", "suffix").distinct()
    ends = asked.select("dir", "stem", "suffix", F.explode(F.array_distinct(F.array("suffix", *map(F.lit, companions)))).alias("end"))
    parts = F.split("name", r"\.")
    splits = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))  # every head that a suffix may follow
    named = taken.select("dir", "name").distinct().select("dir", "name", F.explode(splits).alias("head"))
    named = named.withColumn("end", F.col("name").substr(F.length("head") + 1, F.length("name")))
    head = F.col("head")
    number = F.regexp_extract(head, r"_([2-9]|[1-9][0-9]{1,17})$", 1)
    whole = named.select("dir", "end", head.alias("stem"), F.lit(1).cast("long").alias("n"))
    counted = named.where(number != "").select("dir", "end", head.substr(F.lit(1), F.length(head) - F.length(number) - 1).alias("stem"), number.cast("long").alias("n"))
    used = ends.join(whole.unionByName(counted), ["dir", "stem", "end"]).select("dir", "stem", "suffix", "n").distinct()
    place = F.row_number().over(Window.partitionBy("dir", "stem", "suffix").orderBy("n"))
    gaps = used.withColumn("place", place).groupBy("dir", "stem", "suffix").agg(F.coalesce(F.min(F.when(F.col("n") != F.col("place"), F.col("place"))), F.max("n") + 1).alias("free"))
    free = F.coalesce("free", F.lit(1))
    return asked.join(gaps, ["dir", "stem", "suffix"], "left").select("dir", "stem", "suffix", F.concat("stem", F.when(free > 1, F.concat(F.lit("_"), free)).otherwise(""), "suffix").alias("name"))


def publish(path: str, text: str) -> None:
    """Writes a small file whole or not at all."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as f:
        f.write(text)
    os.replace(f.name, path)


def write_json(path: str, report: dict) -> None:
    publish(path, json.dumps(report, ensure_ascii=False, indent=2))


def html_report(report: dict, lang: str = "en") -> str:
    """A page with the counters, a table of changes and one of findings.  report: counters, changes, findings as dicts."""
    e = lambda v: html.escape("" if v is None else str(v))
    cards = "".join(f"<div class=card><b>{e(v)}</b><span>{e(k)}</span></div>" for k, v in report.get("counters", {}).items())
    changed = "".join(f"<tr><td>{e(c.get('location'))}<td><code>{e(c.get('before'))}</code><td><code>{e(c.get('after'))}</code><td>{e(c.get('reason'))}</tr>" for c in report.get("changes", []))
    found = "".join(f"<tr class={e(f.get('severity'))}><td>{e(f.get('code'))}<td>{e(f.get('location'))}<td>{e(f.get('message'))}<td>{e(f.get('suggestion'))}</tr>" for f in report.get("findings", []))
    return f"<!doctype html><html lang={e(lang)} dir={'rtl' if lang == 'fa' else 'ltr'}><meta charset=utf-8><body>{cards}<table>{changed}</table><table>{found}</table></body></html>"
