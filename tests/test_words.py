"""Packages as a data source, byte splices, the compile boundary."""

import io
import os
import time
import zipfile

import pytest

from glyphmill import api
from glyphmill.operators import compiling, package, splicing
from glyphmill.operators.splicing import Edit, Unsafe, decoded, indexed, spliced
from glyphmill.sources import word

W, M = splicing.W, splicing.M
MATH = f'<m:oMath xmlns:m="{M}"><m:r><m:t>x</m:t></m:r></m:oMath>'.encode()
ODD = (
    f"<?xml version='1.0'  encoding='%s' standalone='yes'?>\r\n<w:document  xmlns:w='{W}' xmlns:mc=\"urn:mc\"\tmc:Ignorable='w14' xmlns:w14='urn:w14'><w:body><!-- > -->"
    "<w:p w:a=\">\"><w:pPr/><w:r><w:rPr><w:b w:val='1'/></w:rPr><w:t>a &amp; $x$ &#233;</w:t></w:r></w:p>"
    "<mc:Choice xmlns:wps='urn:wps' Requires='wps'><w:p><w:r><w:t>b $y</w:t></w:r><w:proofErr/><w:r><w:t>$ c</w:t></w:r></w:p></mc:Choice><w:p/>"
    "<w:p ><w:r><w:drawing><w:p><w:r><w:t>inner $z$</w:t></w:r></w:p></w:drawing></w:r><w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink><w:r><w:t xml:space='preserve"
    "'> $q$</w:t></w:r></w:p><w:p><w:pPr><w:jc/></w:pPr><w:r><w:t> $$d$$ </w:t></w:r></w:p></w:body></w:document>\n<!-- end -->"
)


def part(encoding="UTF-8"):
    return (ODD % encoding).encode(encoding)


def texts(data):
    return [p.text for p in indexed(decoded(data)[0])]


def test_texts_are_those_of_the_tree():
    assert texts(part()) == ["a & $x$ é", "b $y$ c", "", "inner $z$link $q$", "inner $z$", " $$d$$ "]
    assert texts(part("UTF-16")) == texts(part("ISO-8859-1")) == texts(b"\xef\xbb\xbf" + part()) == texts(part())


@pytest.mark.parametrize("encoding", ["UTF-8", "UTF-16", "ISO-8859-1"])
def test_bytes_outside_of_edits_stay(encoding):
    before = part(encoding)
    after, n, reasons = spliced(before, {0: [Edit(4, 7, MATH)], 3: [Edit(14, 17, MATH)]})
    codec = {"UTF-16": "utf-16"}.get(encoding, encoding)
    old, new = before.decode(codec), after.decode(codec)
    assert n == 2 and not reasons and before[:2] == after[:2]
    run = "<w:r><w:rPr><w:b w:val='1'/></w:rPr><w:t xml:space=\"preserve\">"
    old = old.replace("<w:r><w:rPr><w:b w:val='1'/></w:rPr><w:t>a &amp; $x$ &#233;</w:t></w:r>", f"{run}a &amp; </w:t></w:r>{MATH.decode()}{run} é</w:t></w:r>")
    assert new == old.replace("<w:r><w:t xml:space='preserve'> $q$</w:t></w:r>", f'<w:r><w:t xml:space="preserve"> </w:t></w:r>{MATH.decode()}')


def test_spans_over_runs_and_blocks():
    after, n, _ = spliced(part(), {1: [Edit(2, 5, MATH)], 4: [Edit(6, 9, MATH)], 5: [Edit(1, 6, MATH, True)]})
    assert n == 3 and texts(after) == ["a & $x$ é", "b  c", "", "inner link $q$", "inner ", ""]
    text = after.decode()
    assert "proofErr" not in text and "xmlns:wps='urn:wps' Requires='wps'" in text
    assert f'<w:pPr><w:jc/></w:pPr><m:oMathPara xmlns:m="{M}">{MATH.decode()}</m:oMathPara></w:p>' in text


def test_two_formulas_of_one_run():
    data = f'<w:document xmlns:w="{W}"><w:p><w:r><w:t>$a$ and $b$</w:t></w:r></w:p></w:document>'.encode()
    after, n, _ = spliced(data, {0: [Edit(8, 11, MATH, True), Edit(0, 3, MATH)]})
    assert n == 2 and after == data.replace(b"<w:r><w:t>$a$ and $b$</w:t></w:r>", MATH + b'<w:r><w:t xml:space="preserve"> and </w:t></w:r>' + MATH)


@pytest.mark.parametrize(("i", "edit", "reason"), [
    (3, Edit(9, 12, MATH), "map"), (3, Edit(0, 5, MATH), "crosses"), (3, Edit(12, 16, MATH), "map"), (0, Edit(3, 99, MATH), "map"), (0, Edit(3, 3, MATH), "map"),
    (0, Edit(4, 7, b"<x/>"), "Office Math"), (0, Edit(4, 7, b"<m:oMath/>"), "well formed"), (9, Edit(0, 1, MATH), "no paragraph"),
])
def test_unsafe_edits(i, edit, reason):
    with pytest.raises(Unsafe, match=reason):
        spliced(part(), {i: [edit]})
    if i < 9:
        assert spliced(part(), {i: [edit]}, best_effort=True)[:2] == (part(), 0)


def test_overlap_and_no_prefix():
    with pytest.raises(Unsafe, match="overlap"):
        spliced(part(), {0: [Edit(3, 7, MATH), Edit(5, 8, MATH)]})
    data = f'<document xmlns="{W}"><p><r><t>$a$ b</t></r></p></document>'.encode()
    assert spliced(data, {0: [Edit(0, 3, MATH)]})[0] == data.replace(b"<r><t>$a$ b</t></r>", MATH + b'<r><t xml:space="preserve"> b</t></r>')


def docx(*paragraphs, extra=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{"".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in paragraphs)}</w:body></w:document>')
        z.writestr("word/media/a.png", b"\x89PNG")
        for name, data in extra:
            z.writestr(name, data)
    return out.getvalue()


@pytest.fixture()
def folder(tmp_path):
    at = tmp_path / "in"
    at.mkdir()
    (at / "a.docx").write_bytes(docx("one $x_1$", "two $y$"))
    (at / "b.docx").write_bytes(docx("one $x_1$", extra=[("word/header1.xml", f'<w:hdr xmlns:w="{W}"><w:p><w:r><w:t>$x_1$</w:t></w:r></w:p></w:hdr>')]))
    (at / "plain.docm").write_bytes(docx("nothing"))
    (at / "torn.docx").write_bytes(docx("x")[:-40])
    (at / "other.txt").write_text("no")
    return str(at)


def test_filters_are_pushed(spark, folder):
    rows = word.read_parts(spark, folder)
    assert sorted((os.path.basename(r.path), r.part) for r in rows.where("error is null").collect()) == [("a.docx", "word/document.xml"), ("b.docx", "word/document.xml"), ("b.docx", "word/header1.xml"), ("plain.docm", "word/document.xml")]
    some = rows.where("part = 'word/header1.xml' and path like '%/b.docx'")
    assert [r.part for r in some.collect()] == ["word/header1.xml"]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan or "header1" not in plan.partition("Filter")[2].partition("\n")[0]  # nothing is left for Spark to test
    reader = word.PartsReader({"path": folder})
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringEndsWith

    left = list(reader.pushFilters([EqualTo(("part",), "word/header1.xml"), StringEndsWith(("path",), "b.docx"), GreaterThan(("size",), 3)]))
    assert [type(f) for f in left] == [GreaterThan]
    assert [os.path.basename(p) for x in reader.partitions() for p in x.paths] == ["b.docx"]
    assert [r[1] for x in reader.partitions() for r in reader.read(x)] == ["word/header1.xml"]


def test_packages_are_dealt_out_by_bytes(folder):
    assert [len(p.paths) for p in word.PartsReader({"path": folder, "partitionBytes": "1"}).partitions()] == [1, 1, 1, 1]
    assert [len(p.paths) for p in word.PartsReader({"path": folder}).partitions()] == [4]


@pytest.mark.filterwarnings("ignore:Duplicate name")
def test_refusals_are_those_of_admission(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(package, "MOST_RATIO", 50)
    monkeypatch.setattr(package, "MOST_MEMBERS", 6)
    packages = {"ok": docx("x"), "twice": docx("x", extra=[("word/document.xml", "<x/>")]), "ratio": docx("x" * 100_000), "many": docx("x", extra=[(f"f{i}", "") for i in range(9)]), "torn": b"PK"}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("x", "y")
    packages["lacking"] = out.getvalue()
    want = {}
    for r in package.admission(package.members(spark.createDataFrame([(k, bytearray(v)) for k, v in packages.items()], "path string, content binary"))).collect():
        want[r.path] = r.error
    got = {}
    for name, data in packages.items():
        (tmp_path / f"{name}.docx").write_bytes(data)
    reader = word.PartsReader({"path": str(tmp_path)})
    for x in reader.partitions():
        for r in reader.read(x):
            got[os.path.basename(r[0]).removesuffix(".docx")] = r[-1]
    assert got == want and len(set(want.values())) == 6


def test_publish(spark, folder, tmp_path):
    seen = str(tmp_path / "seen")

    def compiler(formulas):
        with open(seen, "a") as f:
            f.writelines(x + "\n" for x in formulas)
        return dict.fromkeys(formulas, MATH)

    target = str(tmp_path / "out")
    status = {r.file: r for r in api.publish_words(spark, folder, target, batch_compiler=compiler).collect()}
    assert {k: (r.published, r.converted) for k, r in status.items()} == {"a.docx": (True, 2), "b.docx": (True, 2), "plain.docm": (True, 0), "torn.docx": (False, 0)}
    assert "read" in status["torn.docx"].error
    assert sorted(open(seen).read().split()) == ["x_{1}", "y"] or sorted(open(seen).read().split()) == ["x_1", "y"]  # once for the corpus
    assert sorted(os.listdir(target)) == ["_status", "a.docx", "b.docx", "plain.docm"]
    with zipfile.ZipFile(f"{target}/plain.docm") as new, zipfile.ZipFile(f"{folder}/plain.docm") as old:
        assert [(i.filename, i.CRC) for i in new.infolist()] == [(i.filename, i.CRC) for i in old.infolist()]
    with pytest.raises(Exception, match="already there"):
        api.publish_words(spark, folder, target, batch_compiler=compiler)
    assert sorted(os.listdir(target)) == ["_status", "a.docx", "b.docx", "plain.docm"]
    api.publish_words(spark, folder, target, overwrite=True, batch_compiler=compiler)
    with pytest.raises(ValueError):
        api.publish_words(spark, folder, folder, batch_compiler=compiler)


def test_an_aborted_write_leaves_nothing(spark, tmp_path):
    word.registered(spark)
    target = str(tmp_path / "out")
    rows = spark.createDataFrame([(f"f{i}.docx", bytearray(b"x"), 0, [], None) for i in range(20)] + [("../bad.docx", bytearray(b"x"), 0, [], None)], word.WordPackages({}).schema())
    with pytest.raises(Exception, match="not a file name"):
        rows.repartition(4).write.format("wordpackages").mode("append").save(target)
    assert not os.path.exists(target) or os.listdir(target) == []


def test_no_shuffle_holds_packages(spark, folder):
    done = api.repair_words(spark, folder, batch_compiler=lambda f: dict.fromkeys(f, MATH))
    done.collect()
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and not any("content" in line for line in plan.splitlines() if "Exchange" in line)


def test_decisions_concern_their_document(spark, folder):
    rows = api.scan_words(spark, folder).collect()
    same = [r for r in rows if r.candidate_id == "word/document.xml:0:0"]
    assert len(same) == 2
    a = next(r for r in same if r.doc.endswith("a.docx"))
    decisions = spark.createDataFrame([(a.doc, a.candidate_id, False, "\n\t"), (a.doc, a.candidate_id, True, " ")], "doc string, candidate_id string, enabled boolean, override string")
    done = {os.path.basename(r.path): r.converted for r in api.repair_words(spark, folder, lambda tex: MATH, decisions).collect()}
    assert done == {"a.docx": 1, "b.docx": 2, "plain.docm": 0, "torn.docx": 0}
    kept = api.repair_words(spark, folder, lambda tex: MATH, decisions)
    counted = {os.path.basename(r.doc): r for r in api.words_report(spark, folder, kept, decisions).collect()}
    r = counted["a.docx"]
    assert (r.scanned_parts, r.scanned_paragraphs, r.already_native, r.detected, r.converted, r.skipped) == (1, 2, 0, 2, 1, 1)
    assert counted["torn.docx"].scanned_parts == 0 and counted["b.docx"].scanned_parts == 2


def test_failed_formulas(spark, folder):
    def compiler(tex):
        if tex == "y":
            raise ValueError("no y")
        return MATH

    rows = {os.path.basename(r.path): r for r in api.repair_words(spark, folder, compiler).collect()}
    assert rows["a.docx"].content is None and "1 formula(s)" in rows["a.docx"].error and rows["b.docx"].converted == 2
    rows = {os.path.basename(r.path): r for r in api.repair_words(spark, folder, compiler, best_effort=True).collect()}
    assert rows["a.docx"].converted == 1 and rows["a.docx"].warnings[0].startswith("PANDOC_FORMULA_FAILED: y")


def test_hung_compilers_are_stopped():
    began = time.monotonic()
    with pytest.raises(TimeoutError):
        compiling.bounded(lambda f: time.sleep(10), ["x"], 0.2)
    assert time.monotonic() - began < 3
    with pytest.raises(compiling.Failed, match="ended"):
        compiling.bounded(lambda f: os._exit(3), ["x"], 5)
    with pytest.raises(compiling.Failed, match="ValueError: bad"):
        compiling.bounded(lambda f: (_ for _ in ()).throw(ValueError("bad")), ["x"], 5)
    assert compiling.bounded(lambda f: {x: b"1" * 10**6 for x in f}, ["x", "y"], 5).keys() == {"x", "y"}


def test_no_batch_is_tried_after_one_that_hangs(monkeypatch):
    tried = []

    def hang(compiler, formulas, seconds):
        tried.append((list(formulas), seconds))
        raise TimeoutError("timed out")

    monkeypatch.setattr(compiling, "bounded", hang)
    rows = list(compiling.compile_all(None, [str(i) for i in range(5)], batch=1))
    assert tried == [(["0"], 30.0)] and [r[2] for r in rows] == ["PANDOC_TIMEOUT"] * 5


def test_total_time(monkeypatch):
    clock = iter([0, 1, 20, 46, 46, 46])
    monkeypatch.setattr(compiling, "bounded", lambda compiler, formulas, seconds: {f: str(seconds).encode() for f in formulas})
    rows = list(compiling.compile_all(None, list("abcd"), batch=1, clock=lambda: next(clock)))
    assert rows[:2] == [("a", b"30.0", None, None), ("b", b"25.0", None, None)] and [r[2] for r in rows[2:]] == ["PANDOC_TOTAL_TIMEOUT"] * 2


def test_failing_batches_are_halved(spark):
    def compiler(formulas):
        if "bad" in formulas:
            raise ValueError("bad one")
        return {f: f.encode() for f in formulas if f != "odd"}

    rows = spark.createDataFrame([(f" f{i % 20}\t",) for i in range(60)] + [("bad",), ("odd",), (None,)], "normalized string")
    got = {r.normalized: (r.markup, r.code) for r in compiling.compiled(rows, compiler, batch=8).collect()}
    assert len(got) == 22 and got["bad"] == (None, "PANDOC_BATCH_FAILED") and got["odd"] == (None, "PANDOC_FORMULA_FAILED")
    assert all(bytes(v[0]).decode() == k for k, v in got.items() if k.startswith("f"))
    places = spark.createDataFrame([("d", "p", 3, " bad")], "doc string, part string, paragraph_index int, normalized string")
    assert [r.code for r in compiling.warnings(places, compiling.compiled(rows, compiler)).collect()] == ["PANDOC_BATCH_FAILED"]


def test_a_folder_is_dealt_out_however_well_it_is_compressed(tmp_path):
    for i in range(8):
        (tmp_path / f"{i}.docx").write_bytes(b"x" * 50_000)  # each of them may hold thousands of paragraphs
    assert [len(p.paths) for p in word.PartsReader({"path": str(tmp_path)}).partitions()] == [1] * 8


def test_packages_are_patched_by_more_tasks_than_one(spark, tmp_path):
    from pyspark.sql import functions as F

    for i in range(12):
        (tmp_path / f"{i}.docx").write_bytes(docx("one $x$ and $x$", f"two $y_{i}$", *(f"{os.urandom(20).hex()}" for _ in range(1500))))
    done = api.repair_words(spark, str(tmp_path), batch_compiler=lambda f: {x: MATH for x in f if x != "y_3"}, best_effort=True)
    rows = done.select("path", "converted", "warnings", "error", F.spark_partition_id().alias("task")).collect()
    assert len({r.task for r in rows}) > 4 and len(rows) == 12
    assert {os.path.basename(r.path): (r.converted, len(r.warnings)) for r in rows} == {f"{i}.docx": (2, 1) if i == 3 else (3, 0) for i in range(12)}


def test_a_failed_formula_is_told_for_each_place(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx("one $x$ and $x$ and $y$"))
    row = api.repair_words(spark, str(tmp_path), batch_compiler=lambda f: {x: MATH for x in f if x != "x"}, best_effort=True).first()
    assert row.converted == 1 and len(row.warnings) == 2 and all(w.startswith("PANDOC_FORMULA_FAILED: x") for w in row.warnings)


def test_prepared_packages_are_read_once(spark, folder, tmp_path):
    prepared = api.prepared_words(spark, folder)
    kept = api.repair_words(spark, folder, lambda tex: MATH)
    again = api.repair_words(spark, folder, lambda tex: MATH, prepared=prepared)
    key = lambda df: sorted((r.path, r.converted, r.error) for r in df.collect())
    assert key(kept) == key(again)
    report = api.words_report(spark, folder, kept.drop("content"), prepared=prepared)
    assert sorted(map(tuple, report.collect())) == sorted(map(tuple, api.words_report(spark, folder, kept.drop("content")).collect()))
    plan = api.words_report(spark, folder, spark.createDataFrame([], "path string, converted int, warnings array<string>, error string"), prepared=prepared)._jdf.queryExecution().executedPlan().toString()
    assert "wordparts" not in plan and "MapInPandas" not in plan


def test_a_torn_end_tag_is_unsafe():
    for torn in (part()[:-3], f'<w:p xmlns:w="{W}"><w:r></w:'.encode(), f'<w:p xmlns:w="{W}" a="x>'.encode()):
        with pytest.raises(Unsafe):
            indexed(torn)


def test_packages_of_a_small_table_are_built_by_many_tasks(spark):
    import glob

    from glyphmill.plans import packages as plans

    folder = plans.word_folder(spark, "/root/testdata/sf0.001")
    tasks = glob.glob(folder.removeprefix("file://") + "/_status/*/*.json")  # one for each task that wrote
    assert len(tasks) > 10


ODD_TEXTS = [
    part(),
    f'<document xmlns="{W}" xmlns:q="{W}"><p><q:r><t>a</t></q:r><r><q:t>b</q:t><t/></r><ins><r><t>c</t></r></ins><sdt><r><t>no</t></r></sdt></p></document>'.encode(),
    f'<w:document xmlns:w="{W}"><w:p><w:ins><w:hyperlink><w:r><w:t>no</w:t></w:r></w:hyperlink></w:ins><w:r><w:t>a<w:x>no</w:x>b<!-- c --><![CDATA[<w:p>]]></w:t></w:r><w:x xmlns:w="urn:o"><w:p/></w:x></w:p></w:document>'.encode(),
    f'<w:document xmlns:w="{W}"><u:p/><w:p><w:r><w:t>a prefix without a declaration</w:t></w:r></w:p></w:document>'.encode(),
]


@pytest.mark.parametrize("data", ODD_TEXTS)
def test_texts_are_those_of_the_index(data):
    assert splicing.paragraph_texts(data) == [p.text for p in indexed(data)] != []
    for bad in (data[:-20], b"<!DOCTYPE x>" + data.partition(b"?>")[2] if data.startswith(b"<?") else b"<!DOCTYPE x>" + data):
        reasons = []
        for f in (splicing.paragraph_texts, indexed):
            with pytest.raises(Unsafe) as e:
                f(bad)
            reasons.append(str(e.value))
        assert reasons[0] == reasons[1]


def test_places_are_noted_once_and_only_for_edits(monkeypatch):
    seen = []
    monkeypatch.setattr(splicing, "indexed", lambda data: seen.append(data) or indexed(data))
    assert package.texts(part())[1] == "b $y$ c" and not seen
    assert spliced(part(), {1: [Edit(2, 5, MATH)]})[1] == 1 and seen == [part()]  # the result is read back for its texts alone
