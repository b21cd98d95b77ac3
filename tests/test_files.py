import json
import os
import zipfile

import pytest

from glyphmill import api
from glyphmill.operators.candidates import candidates
from glyphmill.sources import files
from glyphmill.streaming.rows import candidate_stream


@pytest.fixture()
def project(tmp_path):
    root = tmp_path / "proj"
    (root / "chapters").mkdir(parents=True)
    (root / "main.tex").write_text("\\input{chapters/results}\\bibliography{refs}\n\\ref{eq:missing} \\input{../secret} \\include{gone}")
    (root / "chapters" / "results.tex").write_bytes("line\n$x=\\frac\\alpha\\beta$ \\cite{missing-key} \\cite{known}".encode() + b" \xff")
    (root / "unused.tex").write_text("\\frac12")
    (root / "refs.bib").write_text("@book{known, title={x}}")
    (root / "x.aux").write_text("no")
    return root


def test_scan(spark, project):
    changes, findings = api.scan_project(spark, str(project))
    assert [(c.file, c.line, c.after) for c in changes.collect()] == [("chapters/results.tex", 2, "\\frac{\\alpha}{\\beta}")]
    got = {(f.code, f.file, f.line) for f in findings.collect()}
    assert {("MISSING_CITATION", "chapters/results.tex", 2), ("MISSING_REFERENCE", "main.tex", 2), ("UNSAFE_INCLUDE", "main.tex", 2), ("MISSING_INCLUDE", "main.tex", 2)} <= got
    assert not any(c == "MISSING_CITATION" and f == "main.tex" for c, f, _ in got)


def test_publish(spark, project, tmp_path):
    target = tmp_path / "out"
    target.mkdir()
    (target / "old").write_text("old")
    assert api.repair_project(spark, str(project), str(target)) == 2
    assert "\\frac{\\alpha}{\\beta}" in (target / "chapters" / "results.tex").read_text(errors="replace")
    assert not (target / "old").exists() and not (target / "x.aux").exists() and len(os.listdir(tmp_path)) == 2


def test_bundle(tmp_path):
    data = files.review_bundle({"input_path": "/private/user/thesis.tex", "detected": 3})
    (tmp_path / "b").write_bytes(data)
    with zipfile.ZipFile(tmp_path / "b") as z:
        assert set(z.namelist()) == {"manifest.json", "report.json"} and json.loads(z.read("report.json"))["input_path"] == "thesis.tex"
    with pytest.raises(ValueError):
        files.review_bundle({}, ["x"])
    (tmp_path / "r.json").write_text("[]")
    with pytest.raises(ValueError):
        files.read_review(str(tmp_path / "r.json"))


def test_boundaries(spark):
    with pytest.raises(api.NotAvailable):
        api.repair_words(spark, "/tmp")
    assert api.doctor(spark)["spark"] == spark.version


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("d", "p", 0, "a $x$ b")], "doc string, part string, paragraph_index int, text string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = candidate_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("found").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start().awaitTermination()
    assert [r.source for r in spark.table("found").collect()] == [r.source for r in candidates(rows).collect()] == ["$x$"]
    with pytest.raises(ValueError):
        candidate_stream(rows)


def test_scan_of_every_stage(spark, project):
    from glyphmill.operators import plugins

    (project / "main.log").write_text("(./main.tex\n! Undefined control sequence.\nl.7 \\foo\nLaTeX Warning: Reference `a' on page 1 undefined on input line 3.\nLaTeX Font Warning: Size\n not there\n\n)")
    (project / "other.bib").write_text("@book{missing-key, title={x}}")
    registry = plugins.Registry()
    registry.add("bad", lambda sources, meta: 1 / 0)
    registry.add("old", lambda sources, meta: [], "1.0")
    _, findings = api.scan_project(spark, str(project), profile="tehran", registry=registry, adapter={"name": "U", "required_files": ["u.cls", "x.aux"], "required_commands": ["\\ref"]})
    got = [r.code for r in findings.collect()]
    assert got[0] == "THESIS_TEMPLATE_MISSING"
    assert got[-6:] == ["LATEX_COMPILE_ERROR", "UNDEFINED_REFERENCE", "FONT_WARNING", "PLUGIN_FAILURE", "TEMPLATE_FILE_MISSING", "PLUGIN_LOAD_ERROR"]
    assert "MISSING_CITATION" in got  # its key stands in a .bib that no unit declares


def test_project_beyond_the_guard(spark, tmp_path):
    (tmp_path / "main.tex").write_text("".join(f"\\input{{u{i}}}\n" for i in range(256)) + "\\ref{x}")
    for i in range(256):
        (tmp_path / f"u{i}.tex").write_text("\\frac12")
    changes, findings = api.scan_project(spark, str(tmp_path))
    assert [r.code for r in findings.collect()] == ["PROJECT_TOO_LARGE"] and changes.count() == 0


def test_command_line_prints_every_row(spark, project, capsys):
    from glyphmill import cli

    (project / "chapters" / "results.tex").write_text("\n".join(f"\\frac{i % 9}{i % 7}" for i in range(1200)))
    assert cli.main(["project", str(project)]) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert sum("after" in x for x in lines) == 1200



def test_units_come_in_the_order_of_includes(spark, tmp_path):
    """The main file's name is neither the first nor its hash the least; z is included before a, b by a."""
    (tmp_path / "main.tex").write_text("\\frac12 \\input{z}\n\\input{a} \\input{ gone\n}")
    (tmp_path / "z.tex").write_text("\\frac34 \\cite{k}")
    (tmp_path / "a.tex").write_text("\\input{b}\\input{z}\\frac56 \\ref{l}")
    (tmp_path / "b.tex").write_text("\\frac78 {")
    (tmp_path / "x.bib").write_text("")
    changes, findings = api.scan_project(spark, str(tmp_path))
    assert sorted((r.change_id for r in changes.collect()), key=lambda x: int(x.rpartition(":")[2])) == ["tex:main.tex:1:0", "tex:z.tex:1:1", "tex:a.tex:1:2", "tex:b.tex:1:3"]
    rows = [(r.code, r.file, r.severity) for r in findings.collect()]
    assert rows == [("UNBALANCED_BRACES", "b.tex", "error"), ("MISSING_INCLUDE", "main.tex", "error"), ("MISSING_CITATION", "z.tex", "warning"), ("MISSING_REFERENCE", "a.tex", "warning")]
    missing = findings.where("code = 'MISSING_INCLUDE'").first()
    assert missing.message == "Included file ' gone\n' was not found." and missing.suggestion == "Restore the file or correct the \\input/\\include path." and missing.line == 2


def test_repair_holds_the_guard(spark, tmp_path):
    root, target = tmp_path / "in", tmp_path / "out"
    root.mkdir()
    (root / "main.tex").write_text("".join(f"\\input{{u{i}}}\n" for i in range(300)))
    for i in range(300):
        (root / f"u{i}.tex").write_text("\\frac12")
    with pytest.raises(ValueError, match="too many"):
        api.repair_project(spark, str(root), str(target))
    assert not target.exists()
