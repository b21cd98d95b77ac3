"""Diagnostics plugins: Python functions over a project's units, isolated from each other, and data-only template adapters."""

from __future__ import annotations

import json
import pickle
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.graph import short
from glyphmill.schemas import FINDING

#: Major version of plugins that this engine runs, profiles, and what adapters may name.
API_MAJOR = 2
PROFILES = ("generic", "sharif", "tehran", "amirkabir", "tabriz", "azad")
SUFFIXES = (".cls", ".sty", ".tex", ".cfg", ".def")
MOST_ADAPTER_BYTES = 256 << 10


def _row(code: str, message: str, suggestion: str = "", severity: str = "warning", file: str = "", line=None, plugin: str = "") -> dict:
    return {"code": code, "message": message, "suggestion": suggestion, "severity": severity, "file": file, "line": line, "plugin": plugin}


@dataclass(frozen=True)
class PerUnit:
    """A plugin that sees one unit at a time: analyze(file, text, metadata) gives findings, or with `merge` a summary.

    Summaries of a project's units meet two at a time, merge(a, b), first within a task; finish(summary) gives the findings.  merge must not
    depend on the order of units.
    """

    analyze: Callable
    merge: Callable | None = None
    finish: Callable | None = None


PARTIAL = pa.schema([("project", pa.string()), ("place", pa.int32()), ("file", pa.string()), ("pos", pa.int32()), ("failure", pa.string()), ("summary", pa.binary()), ("finding", pa.string())])
PARTIALS = "project string, place int, file string, pos int, failure string, summary binary, finding string"


class Registry:
    """Plugins by name.  Of another major version: a load error.

    ``add`` takes f(sources: dict of file to text, metadata: dict) -> findings as dicts, for which a project's texts meet in one group;
    ``add_per_unit`` a PerUnit, for which no texts meet, so a project of many files runs over many tasks.
    """

    def __init__(self):
        self.plugins: dict[str, Callable | PerUnit] = {}
        self.load_errors: list[str] = []

    def add(self, name: str, analyze: Callable | PerUnit, api_version: str = "2.0") -> None:
        major = str(api_version).split(".")[0]
        if major != str(API_MAJOR):
            self.load_errors.append(f"{name}: API {api_version} is not compatible with {API_MAJOR}.0")
        else:
            self.plugins[name] = analyze

    def add_per_unit(self, name: str, analyze: Callable, merge: Callable | None = None, finish: Callable | None = None, api_version: str = "2.0") -> None:
        self.add(name, PerUnit(analyze, merge, finish), api_version)

    def findings(self, units: DataFrame, metadata: dict | None = None) -> DataFrame:
        """units (project, file, text) -> findings by project, pos giving the plugins' order.  A plugin that raises gives one PLUGIN_FAILURE a project; the others go on."""
        names = list(self.plugins)
        whole = {n: p for n, p in self.plugins.items() if not isinstance(p, PerUnit)}
        single = {n: p for n, p in self.plugins.items() if isinstance(p, PerUnit)}
        rows = self._load_errors(units)
        if whole:
            rows = rows.unionByName(self._whole(units, whole, dict(metadata or {}), names))
        if single:
            rows = rows.unionByName(self._single(units, single, dict(metadata or {}), names))
        return rows

    def _load_errors(self, units: DataFrame) -> DataFrame:
        errors = F.array(*(F.lit(e) for e in self.load_errors)).cast("array<string>")
        found = units.select("project").distinct().select("project", F.posexplode(errors).alias("pos", "message"))
        own = {"code": "PLUGIN_LOAD_ERROR", "suggestion": "Update or remove the incompatible plugin.", "severity": "warning", "file": "", "plugin": ""}
        rows = found.withColumns({k: F.lit(v) for k, v in own.items()}).withColumns({"line": F.lit(None).cast("int"), "pos": F.col("pos") + LAST})
        return rows.select("project", *(c.split(" ")[0] for c in FINDING.split(", ")), "pos")

    @staticmethod
    def _whole(units: DataFrame, plugins: dict[str, Callable], meta: dict, names: list[str]) -> DataFrame:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            rows, places = [], []
            for name, analyze in plugins.items():
                try:
                    found = [dict(x) for x in analyze(dict(zip(pdf["file"], pdf["text"])), dict(meta))]
                    own = [_row(**{**x, "plugin": x.get("plugin") or name}) for x in found]
                except Exception as e:  # noqa: BLE001  a plugin's fault is a finding
                    own = [_failure(name, str(e))]
                rows += own
                places += [names.index(name) * WIDE + i for i in range(len(own))]
            out = pd.DataFrame(rows, columns=["code", "message", "suggestion", "severity", "file", "line", "plugin"])
            out.insert(0, "project", pdf["project"].iloc[0])
            out["line"] = out["line"].astype("Int32")
            out["pos"] = places
            return out

        return units.select("project", "file", "text").groupBy("project").applyInPandas(run, f"project string, {FINDING}, pos int")

    @staticmethod
    def _single(units: DataFrame, plugins: dict[str, PerUnit], meta: dict, names: list[str]) -> DataFrame:
        places = {n: names.index(n) for n in plugins}

        def row(project: str, place: int, file: str = "", pos: int = 0, failure: str | None = None, summary: bytes | None = None, finding: str | None = None) -> dict:
            return {"project": project, "place": place, "file": file, "pos": pos, "failure": failure, "summary": summary, "finding": finding}

        def made(name: str, project: str, file: str, found) -> list[dict]:
            own = [_row(**{**{"file": file}, **dict(x), "plugin": dict(x).get("plugin") or name}) for x in found]
            return [row(project, places[name], file, i, finding=json.dumps(x)) for i, x in enumerate(own)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            summaries: dict[tuple[str, str], object] = {}
            for b in batches:
                rows = []
                for r in b.to_pylist():
                    for name, p in plugins.items():
                        try:
                            found = p.analyze(r["file"], r["text"], dict(meta))
                            if p.merge is None:
                                rows += made(name, r["project"], r["file"], found)
                            else:
                                key = r["project"], name
                                summaries[key] = p.merge(summaries[key], found) if key in summaries else found
                        except Exception as e:  # noqa: BLE001  a plugin's fault is a finding
                            rows.append(row(r["project"], places[name], r["file"], failure=str(e)))
                if len(summaries) > MOST_SUMMARIES:
                    rows += [row(project, places[name], summary=pickle.dumps(s)) for (project, name), s in summaries.items()]
                    summaries.clear()
                yield pa.RecordBatch.from_pylist(rows, schema=PARTIAL)
            yield pa.RecordBatch.from_pylist([row(project, places[name], summary=pickle.dumps(s)) for (project, name), s in summaries.items()], schema=PARTIAL)

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for r in b.to_pylist():
                    name = names[r["place"]]
                    try:
                        rows += made(name, r["project"], "", plugins[name].finish(reduce(plugins[name].merge, map(pickle.loads, r["summaries"]))))
                    except Exception as e:  # noqa: BLE001  a plugin's fault is a finding
                        rows.append(row(r["project"], r["place"], failure=str(e)))
                yield pa.RecordBatch.from_pylist(rows, schema=PARTIAL)

        parts = short(units.select("project", "file", "text").mapInArrow(run, PARTIALS))
        merged = parts.where("summary is not null").groupBy("project", "place").agg(F.collect_list("summary").alias("summaries")).mapInArrow(finish, PARTIALS)
        rows = parts.where("summary is null").unionByName(merged)
        failed = rows.where("failure is not null").groupBy("project", "place").agg(F.min_by("failure", "file").alias("failure"))
        name = F.element_at(F.array(*map(F.lit, names)), F.col("place") + 1)
        good = rows.where("finding is not null").join(failed, ["project", "place"], "left_anti").select("project", F.from_json("finding", FINDING).alias("f"), (F.col("place") * WIDE + F.col("pos")).alias("pos"))
        lost = failed.withColumns({"code": F.lit("PLUGIN_FAILURE"), "message": F.concat(name, F.lit(": "), "failure"), "suggestion": F.lit(REPAIR), "severity": F.lit("warning"), "file": F.lit(""), "line": F.lit(None).cast("int"), "plugin": name, "pos": F.col("place") * WIDE})
        columns = [c.split(" ")[0] for c in FINDING.split(", ")]
        return good.select("project", "f.*", "pos").unionByName(lost.select("project", *columns, "pos"))


#: Findings of one plugin in a project or unit that keep their order; where load errors stand; projects and plugins whose summaries a task holds.
WIDE, LAST, MOST_SUMMARIES = 1 << 20, 1 << 30, 10_000
REPAIR = "Update or disable the plugin."


def _failure(name: str, message: str) -> dict:
    return _row("PLUGIN_FAILURE", f"{name}: {message}", REPAIR, "warning", plugin=name)


def parse_adapter(raw: str) -> dict:
    """A checked template adapter; ValueError names the first fault."""
    if len(raw.encode()) > MOST_ADAPTER_BYTES:
        raise ValueError("adapter is too large")
    data = json.loads(raw)
    if not isinstance(data, dict):
        raise ValueError("adapter must be an object")
    name, version = str(data.get("name", "")).strip(), str(data.get("version", "")).strip()
    if not name or not version:
        raise ValueError("adapter needs name and version")
    if str(data.get("api_version", "2.0")).split(".")[0] != str(API_MAJOR):
        raise ValueError("adapter API is not compatible")
    files, commands = data.get("required_files", []), data.get("required_commands", [])
    for f in files:
        parts = re.split(r"[/\\]", str(f))
        if not str(f).endswith(SUFFIXES) or ".." in parts or str(f).startswith("/") or "\\" in str(f):
            raise ValueError(f"adapter file is not allowed: {f}")
    if any(not 1 <= len(str(c)) <= 200 for c in commands):
        raise ValueError("adapter command is not allowed")
    return {"name": name, "version": version, "profile": str(data.get("profile", "generic")), "engine": str(data.get("engine", "xelatex")), "required_files": [str(f) for f in files], "required_commands": [str(c) for c in commands]}


def adapter_findings(units: DataFrame, adapter: dict) -> DataFrame:
    """What an adapter requires and a project lacks: a file by name, a command in any unit.  One aggregate for each project."""
    needs = [("file", f, F.max((F.col("file") == f) | F.col("file").endswith(f"/{f}"))) for f in adapter["required_files"]]
    needs += [("command", c, F.max(F.col("text").contains(c))) for c in adapter["required_commands"]]
    if not needs:
        return units.select("project", F.lit(0).alias("pos"), *(F.lit("").alias(c) for c in ("kind", "item", "code", "message", "suggestion", "severity", "plugin"))).limit(0)
    seen = units.groupBy("project").agg(*(has.alias(f"n{i}") for i, (_, _, has) in enumerate(needs)))
    lacking = F.array_compact(F.array(*(F.when(~F.col(f"n{i}"), F.struct(F.lit(kind).alias("kind"), F.lit(item).alias("item"))) for i, (kind, item, _) in enumerate(needs))))
    rows = seen.select("project", F.posexplode(lacking).alias("pos", "x")).select("project", "pos", "x.kind", "x.item")
    code = F.when(F.col("kind") == "file", "TEMPLATE_FILE_MISSING").otherwise("TEMPLATE_COMMAND_MISSING")
    message = F.when(F.col("kind") == "file", F.concat(F.lit("Template adapter requires '"), "item", F.lit("', but it was not found."))).otherwise(F.concat(F.lit("Template command '"), "item", F.lit("' was not found in the project.")))
    suggestion = F.when(F.col("kind") == "file", "Place the licensed or university-provided template file in the project.").otherwise("Follow the template documentation and add the required declaration.")
    return rows.withColumns({"code": code, "message": message, "suggestion": suggestion, "severity": F.when(F.col("kind") == "file", "error").otherwise("warning"), "plugin": F.lit(adapter.get("name", ""))})


def filled_plugin(plugin: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(plugin, F.lit("")), name)
