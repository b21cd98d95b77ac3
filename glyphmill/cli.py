"""python -m glyphmill.cli scan|convert|project|repair|compare|plugins|bundle|doctor

Rows are printed as lines of JSON, all of them; --json writes a report of them instead.  Programs that this engine does not run (a
formula compiler, a renderer) are given as module:function of the caller's, or not at all.
"""

from __future__ import annotations

import argparse
import json
import sys
from importlib import import_module

from pyspark import cloudpickle

from glyphmill.operators.plugins import PROFILES


def function(name: str):
    """A function named module:function; it goes to the workers by value, as they need not have the module."""
    module, _, attribute = name.partition(":")
    try:
        found = getattr(import_module(module), attribute)
        cloudpickle.register_pickle_by_value(sys.modules[module])
        return found
    except (ImportError, AttributeError, ValueError) as e:
        raise argparse.ArgumentTypeError(f"{name}: {e}") from None


def adapter(path: str) -> dict:
    from glyphmill.operators.plugins import parse_adapter

    try:
        with open(path, encoding="utf-8") as f:
            return parse_adapter(f.read())
    except (OSError, ValueError) as e:
        raise argparse.ArgumentTypeError(f"{path}: {e}") from None


def lines(rows) -> None:
    """Every row as a line of JSON; the driver holds a partition at a time."""
    for r in rows.selectExpr("to_json(struct(*)) as line").toLocalIterator():
        print(r.line)


def report(path: str, **relations) -> None:
    """Relations as one JSON object of lists, written row by row and put in place when it is whole."""
    import os
    import uuid

    staged = f"{path}.{uuid.uuid4().hex}"
    with open(staged, "w", encoding="utf-8") as f:
        f.write("{")
        for i, (name, rows) in enumerate(relations.items()):
            f.write(f"{', ' if i else ''}{json.dumps(name)}: [")
            for j, r in enumerate(rows.selectExpr("to_json(struct(*)) as line").toLocalIterator()):
                f.write(("," if j else "") + "\n" + r.line)
            f.write("]")
        f.write("}\n")
    os.replace(staged, path)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="glyphmill")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *options: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text)
        for o in options:
            c.add_argument(o)
        return c

    def project_options(c: argparse.ArgumentParser) -> None:
        c.add_argument("--main", default="main.tex")
        c.add_argument("--thesis-profile", choices=PROFILES, default="generic")
        c.add_argument("--template-adapter", type=adapter, help="a template adapter's JSON")
        c.add_argument("--plugin", type=function, action="append", default=[], help="module:function of a plugin")

    mode = {"default": "balanced", "choices": ("safe", "balanced", "aggressive")}
    c = command("scan", "formulas of a folder of Word packages, without writing any", "path")
    c.add_argument("--mode", **mode)
    c.add_argument("--json", help="write a report")
    c = command("convert", "repaired copies of a folder's packages and TeX files", "path")
    c.add_argument("--output-dir", "-o", required=True)
    c.add_argument("--mode", **mode)
    c.add_argument("--compiler", type=function, help="module:function from a list of formulas to markup by formula")
    c.add_argument("--overwrite", action="store_true")
    c.add_argument("--continue-on-error", action="store_true")
    c.add_argument("--json", help="write the counters of each package")
    c = command("project", "changes and findings of a LaTeX project", "path")
    project_options(c)
    c.add_argument("--json", help="write a report")
    c = command("repair", "a repaired copy of a LaTeX project", "path")
    project_options(c)
    c.add_argument("--output", "-o", required=True)
    c.add_argument("--json", help="write a report of the project as it was")
    c = command("compare", "two folders of page images, compared", "before", "after", "output")
    c.add_argument("--threshold", type=int, default=12)
    c.add_argument("--tolerance", type=float, default=0.002)
    c = command("plugins", "whether plugins and an adapter can be used")
    c.add_argument("--template-adapter", type=adapter)
    c.add_argument("--plugin", type=function, action="append", default=[])
    c = command("bundle", "a portable bundle of a review", "report", "output")
    c.add_argument("--include-source", action="append", default=[])
    sub.add_parser("doctor", help="versions of what this engine needs")
    return p


def main(args: list[str] | None = None) -> int:
    p = parser()
    a = p.parse_args(args)
    from pyspark.sql import SparkSession

    from glyphmill import api
    from glyphmill.operators.plugins import Registry
    from glyphmill.operators.reports import shown
    from glyphmill.sources import files

    def registry() -> Registry | None:
        r = Registry()
        for f in a.plugin:
            r.add(getattr(f, "name", f.__name__), f, getattr(f, "api_version", "2.0"))
        return r if a.plugin else None

    if a.command == "bundle":
        with open(a.output, "wb") as f:
            f.write(files.review_bundle(files.read_review(a.report), a.include_source, consent=bool(a.include_source)))
        return 0
    if a.command == "plugins":
        r = registry()
        print(json.dumps({"plugins": sorted(r.plugins) if r else [], "load_errors": r.load_errors if r else [], "adapter": a.template_adapter and a.template_adapter["name"]}, ensure_ascii=False))
        return 1 if r and r.load_errors else 0
    spark = SparkSession.builder.appName("glyphmill").getOrCreate()
    if a.command == "doctor":
        print(json.dumps(api.doctor(spark), indent=2))
    elif a.command == "scan":
        found = api.scan_words(spark, a.path, a.mode).select("doc", "candidate_id", "kind", shown("source").alias("source"), "normalized", "repairs")
        relations = {"candidates": found, "findings": api.word_findings(spark, a.path)}
        if a.json:
            report(a.json, **relations)
        else:
            for rows in relations.values():
                lines(rows)
    elif a.command == "convert":
        try:
            done = api.publish_words(spark, a.path, a.output_dir, a.overwrite, batch_compiler=a.compiler, best_effort=a.continue_on_error, mode=a.mode)
        except api.NotAvailable as e:
            p.error(str(e))
        lines(done)
        if a.json:
            report(a.json, packages=api.words_report(spark, a.path, done, mode=a.mode))
        return 1 if done.where("not published").limit(1).count() else 0
    elif a.command in ("project", "repair"):
        changes, findings = api.scan_project(spark, a.path, a.main, a.thesis_profile, registry(), a.template_adapter)
        relations = {"changes": changes.select("change_id", "file", "line", "before", "after", "reason"), "findings": findings}
        if a.json:
            report(a.json, **relations)
        elif a.command == "project":
            for rows in relations.values():
                lines(rows)
        if a.command == "repair":
            try:
                print(api.repair_project(spark, a.path, a.output, a.main))
            except ValueError as e:
                print(f"refused: {e}", file=sys.stderr)
                return 1
    else:
        from glyphmill.operators.images import Comparison

        documents = Comparison(spark, a.before, a.after, a.threshold, a.tolerance).write(a.output)
        lines(documents)
        return 1 if documents.where("error is not null or not passed").limit(1).count() else 0
    return 0


if __name__ == "__main__":
    sys.exit(main())
