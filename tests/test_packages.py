import io
import zipfile

import pytest

from glyphmill.operators import package, raster

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'
MATH = f"<m:oMath {NS}><m:r><m:t>x</m:t></m:r></m:oMath>".encode()


def docx(body, extra=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document {NS}><w:body>{body}</w:body></w:document>')
        z.writestr("word/media/image1.png", b"\x89PNG")
        for n, d in extra:
            z.writestr(n, d)
    return out.getvalue()


def run(t):
    return f"<w:r><w:rPr><w:b/></w:rPr><w:t>{t}</w:t></w:r>"


def packages(spark, *contents):
    return spark.createDataFrame([(f"p{i}", bytearray(c)) for i, c in enumerate(contents)], "path string, content binary")


def test_paragraph_text(spark):
    c = docx(f"<w:p>{run('a $x')}<w:proofErr/>{run('$ b')}<w:hyperlink>{run('link')}</w:hyperlink><w:sdt>{run('no')}</w:sdt></w:p>", [("word/header1.xml", f"<w:hdr {NS}><w:p>{run('h')}</w:p></w:hdr>")])
    rows = [(r.part, r.text) for r in package.paragraphs(packages(spark, c)).orderBy("part").collect()]
    assert rows == [("word/document.xml", "a $x$ blink"), ("word/header1.xml", "h")]


def test_document_type_is_refused(spark):
    c = docx("", [("word/footnotes.xml", '<!DOCTYPE x [<!ENTITY e "boom">]><x>&e;</x>')])
    assert package.paragraphs(packages(spark, c)).where("part like '%footnotes%'").count() == 0
    assert package.structure(packages(spark, c)).where("error like 'STORY_XML_INVALID%'").count() == 1


@pytest.mark.filterwarnings("ignore:Duplicate name")
def test_admission(spark):
    twice = docx("", [("word/document.xml", "<x/>")])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("x", "y")
    errors = [r.error for r in package.admission(package.members(packages(spark, docx(""), twice, out.getvalue()))).orderBy("path").collect()]
    assert errors == [None, "duplicate member", "required part is missing"]


def test_patch_keeps_the_rest(spark):
    c = docx(f"<w:p>{run('Before $x')}{run('^2$ after')}</w:p><w:p>{run('$$y$$')}</w:p>")
    new, n, warnings = package.patch(c, {("word/document.xml", 0): [(7, 12, MATH, False)], ("word/document.xml", 1): [(0, 5, MATH, True)]})
    assert n == 2 and not warnings
    texts = [r.text for r in package.paragraphs(packages(spark, new)).orderBy("paragraph_index").collect()]
    s = package.structure(packages(spark, new)).first()
    assert texts == ["Before  after", ""] and s.math == 2 and s.misplaced == 0
    with zipfile.ZipFile(io.BytesIO(new)) as z:
        assert z.read("word/media/image1.png") == b"\x89PNG" and b"<w:b" in z.read("word/document.xml") and b"oMathPara" in z.read("word/document.xml")


def test_patch_refuses_structure(spark):
    c = docx(f"<w:p><w:hyperlink>{run('$x$')}</w:hyperlink>{run(' $y$')}</w:p>")
    edits = {("word/document.xml", 0): [(0, 3, MATH, False), (4, 7, MATH, False)]}
    with pytest.raises(package.Unsafe):
        package.patch(c, edits)
    assert package.patch(c, edits, best_effort=True)[1:] == (1, ["UNSAFE_WORD_STRUCTURE: formula offsets no longer map to Word text runs"])


def test_patched_isolates_failures(spark):
    p = packages(spark, docx(f"<w:p>{run('$x$')}</w:p>"), b"no zip", docx(""))
    items = spark.createDataFrame([("p0", "word/document.xml", 0, 0, 3, "x", False), ("p1", "word/document.xml", 0, 0, 3, "x", False)], "path string, part string, paragraph_index int, start int, end int, normalized string, display boolean")
    rows = {r.path: r for r in package.patched(p, items, lambda tex: MATH).collect()}
    assert rows["p0"].converted == 1 and rows["p1"].error and rows["p2"].converted == 0 and rows["p2"].error is None


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "utf-16"])
def test_document_type_in_any_encoding(encoding):
    text = '<?xml version="1.0" encoding="%s"?><!DOCTYPE x [<!ENTITY e "boom">]><x>&e;</x>' % ("utf-16" if encoding == "utf-16" else "utf-8")
    with pytest.raises(package.Unsafe):
        package.parse(text.encode(encoding))
    assert package.parse("<x>fine</x>".encode(encoding)).text == "fine"
    with pytest.raises(package.Unsafe):
        package.parse(b"<x>")


def test_unused_prefixes_stay():
    names = NS + ' xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml" mc:Ignorable="w14"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f"<w:document {names}><w:body><w:p>{run('$x$')}</w:p></w:body></w:document>")
    new, n, _ = package.patch(out.getvalue(), {("word/document.xml", 0): [(0, 3, MATH, False)]})
    with zipfile.ZipFile(io.BytesIO(new)) as z:
        data = z.read("word/document.xml")
    assert n == 1 and dict(package.declared(data))["w14"].endswith("/2010/wordml") and b'mc:Ignorable="w14"' in data


@pytest.mark.filterwarnings("ignore:Duplicate name")
def test_one_bad_package_fails_alone(spark, tmp_path):
    from glyphmill import api

    (tmp_path / "good.docx").write_bytes(docx(f"<w:p>{run('a $x$ b')}</w:p>"))
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "twice.docx").write_bytes(docx(f"<w:p>{run('$y$')}</w:p>", [("word/document.xml", f"<w:document {NS}/>")]))
    (tmp_path / "part.docx").write_bytes(docx(f"<w:p>{run('$z$')}</w:p>", [("word/footnotes.xml", "<x>")]))
    name = lambda r: r.path.rpartition("/")[2]
    assert sorted(r.source for r in api.scan_words(spark, str(tmp_path)).collect()) == ["$x$", "$z$"]
    found = {(name(r), r.part, r.code) for r in api.word_findings(spark, str(tmp_path)).collect()}
    assert found == {("bad.docx", "", "PACKAGE_REFUSED"), ("twice.docx", "", "PACKAGE_REFUSED"), ("part.docx", "word/footnotes.xml", "STORY_XML_INVALID")}
    rows = {name(r): r for r in api.repair_words(spark, str(tmp_path), lambda tex: MATH).collect()}
    assert rows["good.docx"].converted == 1 and rows["good.docx"].error is None
    assert rows["twice.docx"].content is None and rows["twice.docx"].error == "duplicate member" and "read" in rows["bad.docx"].error
    assert rows["part.docx"].content is None and "structure_equal" in rows["part.docx"].error


def test_output_is_checked(spark):
    a = docx(f"<w:p>{run('x')}</w:p>")
    rows = [("same", a, a, 0), ("less", a, docx("", [("word/more.xml", "<x/>")]), 0), ("torn", a, a[:-30], 0)]
    got = {r.path: r for r in package.verdicts(spark.createDataFrame([(p, bytearray(b), bytearray(c), n) for p, b, c, n in rows], "path string, before binary, after binary, expected int")).collect()}
    assert got["same"].valid and not got["less"].entries_equal and not got["torn"].valid and got["torn"].error


def pixels(spark, *pages):
    rows = [(side, page, x, y, v, v, v) for side, page, w, h, v in pages for x in range(w) for y in range(h)]
    return spark.createDataFrame(rows, "side string, page long, x int, y int, r int, g int, b int")


def test_raster(spark):
    same = raster.page_diffs(pixels(spark, ("before", 1, 4, 3, 255), ("after", 1, 4, 3, 255)))
    assert raster.verdict(same).first().passed
    wider = raster.page_diffs(pixels(spark, ("before", 1, 4, 3, 0), ("after", 1, 5, 3, 0)))
    r = wider.first()
    assert (r.changed, r.area, r.maximum_delta, r.same_size) == (3, 15, 255, False) and not raster.verdict(wider).first().passed
    alone = raster.page_diffs(pixels(spark, ("before", 1, 2, 2, 0))).first()
    assert (alone.changed, alone.area) == (4, 4)


def test_folder(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx(f"<w:p>{run('x')}</w:p>"))
    (tmp_path / "b.txt").write_text("no")
    assert package.paragraphs(package.read_packages(spark, str(tmp_path))).count() == 1


def test_pairs_are_dealt_out(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from glyphmill.plans import packages as plans

    monkeypatch.setattr(plans, "PAIRS_OF_TASK", 100)
    spark.range(450).selectExpr("id as p_partkey", "cast(id % 50 as int) as p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    pairs = plans.built_pairs(spark, str(tmp_path)).select("path", F.spark_partition_id().alias("task"))
    sizes = [r["count"] for r in pairs.groupBy("task").count().collect()]
    assert len(sizes) == 5 and sum(sizes) == 450  # one file is one split, but not one task
    assert plans.ag3_output(spark, str(tmp_path)).where("valid").count() == sum(k % 7 in (0, 6) for k in range(450))


def test_a_part_of_both_packages_is_counted_once(monkeypatch):
    seen = []
    counters = package.counters
    monkeypatch.setattr(package, "counters", lambda data: seen.append(data) or counters(data))
    a = docx(f"<w:p>{run('x')}</w:p>", [("word/header1.xml", f"<w:hdr {NS}/>")])
    b = docx(f"<w:p>{run('x')}{MATH.decode()}</w:p>{MATH.decode()}", [("word/header1.xml", f"<w:hdr {NS}/>")])
    own = package.checked(a, b, 2)
    assert len(seen) == 3 and own["math_valid"] and not own["placement_valid"] and own["structure_equal"]


def test_required_parts_are_told_where_members_arrive(spark, tmp_path, monkeypatch):
    from glyphmill.plans import packages as plans

    monkeypatch.setattr(plans, "MEMBERS_OF_TASK", 100)
    spark.range(600).selectExpr("id div 3 as l_orderkey", "cast(id % 3 + 1 + id div 300 as int) as l_linenumber").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    found = plans.se4(spark, str(tmp_path))
    assert found.where("missing").count() == 100 and found.count() == 200
    assert found.rdd.getNumPartitions() == 6  # rows decide on the tasks, not their bytes
    plan = found._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1


def test_structure_counts_in_any_encoding(spark):
    odd = f'<w:document {NS}><!-- c --><w:p><w:ins/><w:del/><m:oMath/></w:p><m:oMath><w:p/></m:oMath></w:document>'
    for encoding in ("utf-8", "utf-16"):
        own = package.counters(odd.encode(encoding))  # takes a part's bytes, so no tree is built
        assert (own["math"], own["misplaced"], own["revisions"], own["tables"]) == (2, 1, 2, 0)
    with pytest.raises(package.Unsafe, match="not well formed"):
        package.counters(b"<x>")
    with pytest.raises(package.ET.ParseError):
        package.counters(b"<a:b/>")


def test_a_part_of_many_packages_is_counted_once_a_batch(monkeypatch):
    import pandas as pd

    seen = []
    counters = package.counters
    monkeypatch.setattr(package, "counters", lambda data: seen.append(data) or counters(data))
    same, other = docx(f"<w:p>{run('x')}</w:p>"), docx(MATH.decode())
    bad = docx("", [("word/header1.xml", "<x>")])
    batch = pd.DataFrame({"path": list("abcde"), "content": [same, other, same, bad, bad]})
    (got,) = package._structure([batch])
    assert len(seen) == 5  # a part that can't be read says so in each package
    assert list(zip(got["path"], got["math"], got["misplaced"])) == [("a", 0, 0), ("b", 1, 1), ("c", 0, 0), *((x, 0, 0) for x in "dd"), *((x, 0, 0) for x in "ee")]
    assert [p for p, e in zip(got["path"], got["error"]) if e] == ["d", "e"]


def test_structure_makes_no_pairs(spark, tmp_path):
    from glyphmill.plans import packages as plans

    spark.range(30).selectExpr("id as p_partkey", "cast(id % 50 as int) as p_size").write.parquet(str(tmp_path / "part.parquet"))
    found = plans.ag2(spark, str(tmp_path))
    assert found.count() == 30 and "before#" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert plans.built_pairs(spark, str(tmp_path)).columns == ["path", "before", "after", "expected"]
