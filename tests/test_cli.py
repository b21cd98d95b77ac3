import json
import os

import pytest

from glyphmill import cli
from test_words import MATH, docx


def compiler(formulas):
    return {f: MATH for f in formulas if f != "bad"}


def shouting(sources, metadata):
    return [{"code": "SHOUT", "message": metadata["thesis_profile"], "file": f} for f, t in sources.items() if "!" in t]


def printed(capsys):
    return [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]


@pytest.fixture()
def words(tmp_path):
    at = tmp_path / "in"
    at.mkdir()
    (at / "a.docx").write_bytes(docx("one $x$"))
    (at / "b.docx").write_bytes(docx("two $bad$ and $y$"))
    return str(at)


def test_words(spark, words, tmp_path, capsys):
    assert cli.main(["scan", words]) == 0
    assert sorted(r["source"] for r in printed(capsys)) == ["$bad$", "$x$", "$y$"]
    out, at = str(tmp_path / "out"), str(tmp_path / "r.json")
    assert cli.main(["scan", words, "--json", at]) == 0 and len(json.load(open(at))["candidates"]) == 3
    assert cli.main(["convert", words, "-o", out, "--compiler", "test_cli:compiler"]) == 1
    assert {r["file"]: r["published"] for r in printed(capsys)} == {"a.docx": True, "b.docx": False} and "b.docx" not in os.listdir(out)
    assert cli.main(["convert", words, "-o", out, "--compiler", "test_cli:compiler", "--overwrite", "--continue-on-error", "--json", at]) == 0
    counted = {r["doc"].rpartition("/")[2]: r for r in json.load(open(at))["packages"]}
    assert (counted["b.docx"]["detected"], counted["b.docx"]["converted"]) == (2, 1)
    for bad in (["convert", words, "-o", out], ["convert", words, "-o", out, "--compiler", "test_cli:none"], ["nothing"]):
        with pytest.raises(SystemExit):
            cli.main(bad)


def test_projects(spark, tmp_path, capsys):
    root = tmp_path / "p"
    root.mkdir()
    (root / "main.tex").write_text("\\frac12 ! \\ref{no}")
    (tmp_path / "u.json").write_text('{"name": "U", "version": "1", "required_files": ["u.cls"]}')
    options = ["--thesis-profile", "tehran", "--template-adapter", str(tmp_path / "u.json"), "--plugin", "test_cli:shouting"]
    assert cli.main(["project", str(root), *options]) == 0
    rows = printed(capsys)
    found = {r["code"]: r for r in rows if "code" in r}
    assert set(found) == {"THESIS_TEMPLATE_MISSING", "MISSING_REFERENCE", "SHOUT", "TEMPLATE_FILE_MISSING"} and found["SHOUT"]["message"] == "tehran"
    assert found["TEMPLATE_FILE_MISSING"]["severity"] == "error" and found["MISSING_REFERENCE"]["suggestion"].startswith("Add \\label{no}")
    assert [r["after"] for r in rows if "after" in r] == ["\\frac{1}{2}"]
    at = str(tmp_path / "r.json")
    assert cli.main(["repair", str(root), "-o", str(tmp_path / "q"), "--json", at, *options]) == 0
    assert (tmp_path / "q" / "main.tex").read_text() == "\\frac{1}{2} ! \\ref{no}" and len(json.load(open(at))["findings"]) == 4
    assert cli.main(["plugins", "--plugin", "test_cli:shouting", "--template-adapter", str(tmp_path / "u.json")]) == 0
    assert printed(capsys)[-1] == {"plugins": ["shouting"], "load_errors": [], "adapter": "U"}
    (tmp_path / "bad.json").write_text("[]")
    with pytest.raises(SystemExit):
        cli.main(["project", str(root), "--template-adapter", str(tmp_path / "bad.json")])


def test_other_commands(spark, tmp_path, capsys):
    import numpy as np

    from test_images import write_png

    rng = np.random.default_rng(0)
    for side in ("before", "after"):
        write_png(tmp_path / side / "p1.png", rng.integers(0, 256, (4, 4, 3)))
    assert cli.main(["compare", str(tmp_path / "before"), str(tmp_path / "after"), str(tmp_path / "diff")]) == 1
    assert sorted(os.listdir(tmp_path / "diff")) == ["page-001-diff.png", "visual-comparison.json"] and printed(capsys)[0]["passed"] is False
    (tmp_path / "r.json").write_text('{"input_path": "/a/b.tex"}')
    assert cli.main(["bundle", str(tmp_path / "r.json"), str(tmp_path / "b.zip")]) == 0 and (tmp_path / "b.zip").stat().st_size > 100
    assert cli.main(["doctor"]) == 0
