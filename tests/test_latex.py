import pytest
from pyspark.sql import functions as F

from glyphmill.operators import graph, latex, logs, plugins, reports

UNITS = "project string, seq long, is_main boolean, file string, text string"


def units(spark, *texts):
    return spark.createDataFrame([("p", i, i == 0, f"u{i}.tex", t) for i, t in enumerate(texts)], UNITS)


def keys(spark, *values):
    return spark.createDataFrame([("p", v) for v in values], "project string, key string")


def test_citations_and_references(spark):
    u = units(spark, "\\cite[a][b]{x, y,}\n\\label{e} \\ref{e} \\eqref{no}", "\\label{e}\n\n\\textcite*{z}")
    got = [(r.code, r.file, r.line) for r in latex.workspace_findings(u, keys(spark, "x")).orderBy("step", "seq", "pos").collect()]
    assert got == [("MISSING_CITATION", "u0.tex", 1), ("MISSING_CITATION", "u1.tex", 3), ("MISSING_REFERENCE", "u0.tex", 2), ("DUPLICATE_LABEL", "u0.tex", 2), ("DUPLICATE_LABEL", "u1.tex", 1)]


def test_no_units(spark):
    u = units(spark, "").where("false")
    assert latex.all_findings(u, keys(spark, "x").where("false")).count() == 0


def test_persian_rules(spark):
    got = {r.code for r in latex.unit_findings(units(spark, "متن \\begin{latin} x")).collect()}
    assert got == {"PERSIAN_PACKAGE", "PERSIAN_FONT", "LATIN_FONT", "BIDI_ENV"}


@pytest.mark.parametrize(("before", "after"), [(r"$x=\frac12$", r"$x=\frac{1}{2}$"), ("$x=frac12$", r"$x=\frac{1}{2}$"), (r"\frac\alpha\beta", r"\frac{\alpha}{\beta}"), (r"\frac\alpha{x}", r"\frac{\alph}{a}{x}"), (r"\frac{1}{2}", r"\frac{1}{2}")])
def test_fractions(spark, before, after):
    u = units(spark, before)
    rows = latex.changes(u).withColumn("enabled", F.lit(True))
    assert latex.applied(u, rows).first().output == after


def test_review_of_changes(spark):
    u = units(spark, r"$\frac12$ and $\frac34$")
    ids = [r.change_id for r in latex.changes(u).orderBy("start").collect()]
    decisions = spark.createDataFrame([(ids[0], False, None), (ids[1], True, r"\frac{30}{40}")], "change_id string, enabled boolean, override string")
    out = latex.applied(u, latex.reviewed(latex.changes(u), decisions)).first()
    assert out.output == r"$\frac12$ and $\frac{30}{40}$" and out.n_applied == 1


def test_stale_change_concerns_its_unit_alone(spark):
    two = units(spark, r"\frac12").unionByName(units(spark, r"\frac34").withColumn("project", F.lit("other")))
    rows = latex.changes(two).withColumn("enabled", F.lit(True))
    late = two.withColumn("text", F.when(F.col("project") == "other", F.lit(r"\frac99")).otherwise(F.col("text")))
    got = {r.project: (r.output, r.n_applied, r.error) for r in latex.applied(late, rows).collect()}
    assert got.pop("other") == (r"\frac99", 0, "the text has changed since it was scanned")
    assert list(got.values()) == [(r"\frac{1}{2}", 1, None)]


def test_missing_slash_of_commands(spark):
    assert [r.after for r in latex.changes(units(spark, r"$x=frac\alpha2$ $y=frac12$ \dfrac12")).orderBy("start").collect()] == [r"\frac{\alpha}{2}", r"\frac{1}{2}"]


def test_active_files_against_a_stack(spark):
    import random

    from glyphmill.operators import logs

    rng, rows = random.Random(3), []
    for p in range(4):
        rows += [(f"p{p}", i, "".join(rng.choice(["(./a.tex", "(b.sty", ")", ")", "x ", "(c.cls "]) for _ in range(rng.randint(0, 4)))) for i in range(60)]
    got = {(r.project, r.seq): r.file for r in logs.active_files(spark.createDataFrame(rows, "project string, seq long, text string")).collect()}
    import re

    stacks: dict = {}
    for p, i, text in rows:
        stack = stacks.setdefault(p, [])
        assert got[p, i] == (stack[-1] if stack else None)
        for e in re.findall(logs.OPEN_OR_CLOSE, text):
            if e == ")":
                del stack[-1:]
            else:
                stack.append(e[1:])
    assert len(got) == len(rows)


@pytest.mark.parametrize(("reference", "path"), [("../../secret", None), ("", None), ("/a", None), ("a\\b", None), ("x", "ch/x.tex"), ("../y.sty", "y.sty"), ("./z.tex", "ch/z.tex")])
def test_resolution(reference, path):
    assert graph.resolve(reference, "ch/u.tex") == path


def test_closure_with_cycle(spark):
    e = spark.createDataFrame([("p", "a", "b"), ("p", "b", "c"), ("p", "c", "a"), ("p", "a", "gone")], "project string, src string, dst string")
    n = spark.createDataFrame([("p", x) for x in "abcd"], "project string, node string")
    got = {(r.node, r.depth) for r in graph.closure(n.where("node = 'a'"), e, n).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2)}


def test_log(spark):
    log = [("p", 0, "(./main.tex"), ("p", 1, "(./chapters/results.tex"), ("p", 2, "! Undefined control sequence.\nl.42 \\foo"), ("p", 3, ")"), ("p", 4, "! Missing $ inserted.\n<inserted>\nl.7 x")]
    rows = logs.findings(spark.createDataFrame(log, "project string, seq long, text string")).orderBy("seq").collect()
    assert [(r.file, r.line) for r in rows] == [("./chapters/results.tex", 42), ("./main.tex", 7)] and "usepackage" in rows[0].suggestion


def test_plugins(spark):
    r = plugins.Registry()
    r.add("good", lambda sources, meta: [{"code": "C", "message": "m"}])
    r.add("bad", lambda sources, meta: 1 / 0)
    r.add("old", lambda sources, meta: [], "1.0")
    rows = {(x.code, x.plugin) for x in r.findings(units(spark, "t")).collect()}
    assert rows == {("C", "good"), ("PLUGIN_FAILURE", "bad"), ("PLUGIN_LOAD_ERROR", "")}


def test_adapter(spark):
    a = plugins.parse_adapter('{"name": "U", "version": "1", "required_files": ["university.cls"], "required_commands": ["\\\\universitytitle"]}')
    rows = plugins.adapter_findings(units(spark, "text"), a).collect()
    assert {r.code for r in rows} == {"TEMPLATE_FILE_MISSING", "TEMPLATE_COMMAND_MISSING"} and rows[0].plugin == "U"
    for bad in ('{"name": "U"}', '{"name": "U", "version": "1", "required_files": ["../bad.cls"]}', '{"name": "U", "version": "1", "api_version": "1.0"}', "[]"):
        with pytest.raises(ValueError):
            plugins.parse_adapter(bad)


def test_reports(tmp_path):
    page = reports.html_report({"counters": {"n": 1}, "changes": [{"before": "<a>", "after": "b"}], "findings": [{"code": "X", "message": "m&"}]}, "fa")
    assert "&lt;a&gt;" in page and "rtl" in page and "m&amp;" in page
    reports.write_json(str(tmp_path / "x" / "r.json"), {"ü": 1})
    assert "ü" in (tmp_path / "x" / "r.json").read_text()


def test_splice_order_of_every_unit(spark):
    from glyphmill.plans import registry

    registry.load()
    data = "/root/testdata/sf0.001"
    got = {r.file for r in registry.QUERIES["SO2_splice_order"](spark, data).select("file").collect()}
    assert got == {f"u{r.doc_id}.tex" for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id").collect()}


LISTS = "\\cite{a,\n  b,\tc\u2003}\n\\ref{\nl1} \\label{l1\t} \\bibliography{x,\n\ty}\\addbibresource{ z.bib\n}"


def test_white_space_of_lists(spark):
    u = units(spark, LISTS)
    assert latex.workspace_findings(u, keys(spark, "a", "b", "c")).count() == 0
    assert sorted((r.key, r.line) for r in latex.tokens(u, latex.CITE, True).collect()) == [("a", 1), ("b", 1), ("c", 1)]
    assert sorted(r.value for r in latex.declared_bibliographies(u).collect()) == ["x", "y", "z.bib"]


def test_blank_overrides_keep_the_change(spark):
    u = units(spark, r"$\frac12$")
    decisions = latex.changes(u).selectExpr("change_id", "true as enabled", r"'\n\t' as override")
    assert latex.applied(u, latex.reviewed(latex.changes(u), decisions)).first().output == r"$\frac{1}{2}$"


def test_resolution_as_an_expression(spark):
    import itertools

    names = ["a", ".", "..", "", "x.sty", "..b", ".h", "c.d.e", " ", "é"]
    rows = [("/".join(p), q) for n in (1, 2, 3) for p in itertools.product(names, repeat=n) for q in ("main.tex", "d/u.tex", "d/e/u.tex")]
    rows += [("a\\b", "m.tex"), (None, "m.tex"), ("\u2003x\n", "m.tex")]
    got = spark.createDataFrame(rows, "r string, p string").select("r", "p", graph.resolved("r", "p").alias("path")).collect()
    assert [(r.r, r.p, r.path) for r in got] == [(r, p, graph.resolve(r, p)) for r, p in rows]


def queue(edges, root):
    """Visiting order of one project, as a queue has it."""
    order, pending = [], [root]
    while pending:
        at = pending.pop(0)
        order.append(at)
        for _, dst in sorted((pos, d) for s, d, pos in edges if s == at):
            if dst not in order and dst not in pending:
                pending.append(dst)
    return order


def test_visits_are_those_of_a_queue(spark, monkeypatch):
    import random

    monkeypatch.setattr(graph, "TOGETHER", 3)
    rng, rows, want = random.Random(1), [], {}
    for p in range(12):
        n = rng.randint(1, 14)
        edges = [(s, d, i) for i, (s, d) in enumerate((rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 30)))]
        edges += [(i, i + 1, 99) for i in range(n - 1) if p % 3 == 0]  # long chains
        rows += [(f"p{p}", *e) for e in edges]
        want[f"p{p}"] = queue(edges, 0)
    e = spark.createDataFrame(rows, "project string, src int, dst int, pos int")
    nodes = spark.createDataFrame([(f"p{p}", i) for p in range(12) for i in range(14)], "project string, node int")
    got = {}
    for r in sorted(graph.visited(nodes.where("node = 0"), e, nodes).collect(), key=lambda r: (r.depth, r.path)):
        got.setdefault(r.project, []).append(r.node)
    assert got == want


def test_guards_stop_their_project_alone(spark, monkeypatch):
    monkeypatch.setattr(graph, "MOST_FILES", 5)
    monkeypatch.setattr(graph, "MOST_BYTES", 100)
    rows = []
    for p, n, size in (("chain", 40, 1), ("wide", 9, 1), ("heavy", 4, 60), ("both", 9, 60), ("fine", 5, 20)):
        for i in range(n):
            text = f"\\input{{u{i + 1}}}" if p != "wide" else "".join(f"\\input{{u{j}}}" for j in range(1, n)) if i == 0 else ""
            rows.append((p, i, i == 0, f"u{i}.tex", text + "x" * (size - len(text))))
    from glyphmill.sources import files

    got, _, guard = files.workspace(spark.createDataFrame(rows, UNITS))
    assert {r.project: r.error for r in guard.collect()} == {"chain": graph.TOO_MANY, "wide": graph.TOO_MANY, "heavy": graph.TOO_LARGE, "both": graph.TOO_LARGE}
    assert sorted((r.project, r.seq) for r in got.collect()) == [("fine", i) for i in range(5)]
