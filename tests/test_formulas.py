import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphmill.functions import detection, repairing, text
from glyphmill.operators import candidates


def found(spark, value, mode="balanced"):
    rows = spark.createDataFrame([("d", "p", 0, value)], "doc string, part string, paragraph_index int, text string")
    return candidates.candidates(rows, mode).orderBy("start").collect()


def repair(spark, value, plain=False):
    rows = spark.createDataFrame([(value, plain)], "source string, plain boolean")
    r = repairing.repaired(rows, "source", "plain").first()
    return r.normalized, list(r.repairs)


def test_inline_formulas(spark):
    rows = found(spark, "Correlation is $r = 0.8$, while variables are $X$ and $Y$.")
    assert [r.source for r in rows] == ["$r = 0.8$", "$X$", "$Y$"]
    assert {r.kind for r in rows} == {"latex-inline"} and [r.candidate_id for r in rows] == ["p:0:0", "p:0:1", "p:0:2"]


def test_broken_paragraph(spark):
    (r,) = found(spark, r"$$\text{Diaper} \rightarrow \text{Beer } $$0.5\%, 75\%]$$")
    assert r.kind == "latex-broken" and r.normalized == r"\text{Diaper} \rightarrow \text{Beer } [0.5\%, 75\%]" and r.candidate_id == "p:0:0:57"


@pytest.mark.parametrize(("value", "mode", "n"), [("x = y + 1", "safe", 0), ("x = y + 1", "balanced", 1), ("$x = y + 1$", "safe", 1), ("$x = y + 1", "safe", 0), ("", "balanced", 0), ("  \u00a0 ", "aggressive", 0)])
def test_modes(spark, value, mode, n):
    assert len(found(spark, value, mode)) == n


def test_unknown_mode():
    with pytest.raises(ValueError):
        detection.candidate_spans(None, "bold")


def test_unicode_math(spark):
    (r,) = found(spark, "σ² = √(x) ≤ ∑ xᵢ")
    assert all(s in r.normalized for s in (r"\sigma ^{2}", r"\sqrt{x}", "x_{i}"))
    (r,) = found(spark, "σ² + √x + ∑xᵢ")
    assert r.kind == "unicode-math"
    assert not found(spark, "این یک جمله فارسی است که فرمول ندارد")


def test_null_text(spark):
    rows = spark.createDataFrame([("d", "p", 0, None)], "doc string, part string, paragraph_index int, text string")
    assert candidates.candidates(rows).count() == 0


@pytest.mark.parametrize(("source", "text_", "note"), [
    (r"$$E[X^2] - $$E(x)]^2$$", "E[X^2] - E(x)^2", "removed unmatched closing bracket"),
    (r"$\frac{a}{b}$", r"\frac{a}{b}", None),
    (r"$[0, \infty)$", r"[0, \infty)", None),
    (r"$$E[(X-\mu)^2$$=\begin{} a & \text{if } X ... \end{}$$", r"E[(X-\mu)^2]=\begin{cases} a & \text{if } X ... \end{cases}", "inferred missing cases environment name"),
    (r"a}b{{c\}", r"ab{{c\}}}", "closed unmatched brace"),
])
def test_repairs(spark, source, text_, note):
    got, notes = repair(spark, source)
    assert got == text_ and (note in notes if note else not notes)


def test_null_formula(spark):
    assert repair(spark, None) == (None, [])


def braces(value):
    depth, out, skip = 0, [], False
    for c in value:
        if skip:
            skip = False
        elif c == "\\":
            skip = True
        elif c == "{":
            depth += 1
        elif c == "}":
            if not depth:
                continue
            depth -= 1
        out.append(c)
    return "".join(out) + "}" * depth


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="a{}\\😀", max_size=12), min_size=1, max_size=40))
def test_braces_as_a_loop(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", repairing.balance_braces(F.col("v"))["text"].alias("out")).collect()
    assert all(r.out == braces(r.v) for r in rows)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="a$\\😀é ", max_size=14), min_size=1, max_size=40))
def test_spans_slice_their_source(spark, values):
    p = detection.EXPLICIT[3][0]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", text.matches(F.col("v"), p, 0).alias("m")).collect()
    import re

    for r in rows:
        assert [(x.start, x.end, x.source) for x in r.m] == [(m.start(), m.end(), m[0]) for m in re.finditer(p, r.v)]


def test_native_plan_has_no_python(spark):
    rows = spark.range(1).selectExpr("'d' as doc", "'p' as part", "0 as paragraph_index", "'x = 1' as text")
    plan = candidates.detected(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_ids_of_every_kind(spark):
    from glyphmill.plans import registry

    registry.load()
    data = "/root/testdata/sf0.001"
    rows = registry.QUERIES["WF1_ordinals"](spark, data).collect()
    kinds = {int(r.candidate_id.split(":")[1]) % 13 for r in rows}
    assert kinds == {0, 1, 2, 4, 5, 7, 8, 9, 10, 12} and any(r.candidate_id.count(":") == 3 for r in rows)
    assert len(rows) == registry.QUERIES["SF1_detected_formulas"](spark, data).count()


#: What bracket repair must make of a text, and what it says.
BRACKETS = [
    ("[0, 1)", "[0, 1)", []), (" (a,b] ", " (a,b] ", []), ("(a", "(a)", ["closed unmatched bracket"]), ("a)", "a", ["removed unmatched closing bracket"]),
    ("([)", "([])", ["removed unmatched closing bracket", "closed unmatched bracket"]), ("x 0.5\\%, 75\\%]", "x [0.5\\%, 75\\%]", ["restored a missing opening bracket"]),
    ("(x 12]", "(x [12]", ["restored a missing opening bracket"]), ("x 12] 3]", "x 12 3", ["removed unmatched closing bracket"]), ("\\(", "\\(", []), ("\\text{a) b} )", "\\text{a) b} ", ["removed unmatched closing bracket"]),
    ("y\\text{a)}", "y\\text{a}", ["removed unmatched closing bracket"]), ("a\\", "a\\", []), ("", "", []), ("\\text{(", "\\text{(", []), ("1" + "2" * 60 + "]", "1" + "2" * 20 + "[" + "2" * 40 + "]", ["restored a missing opening bracket"]),
]


def test_brackets(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(BRACKETS)] + [(99, None)], "i int, t string")
    got = {r.i: (r.b.text, r.b.repairs) for r in rows.select("i", repairing.balance_brackets(F.col("t")).alias("b")).collect()}
    assert got.pop(99) == (None, [])
    for i, (t, text_, notes) in enumerate(BRACKETS):
        assert got[i] == (text_, notes), t


@given(st.lists(st.text(alphabet="()[]a1 \\{},", max_size=14), min_size=40, max_size=40))
@settings(max_examples=5, deadline=None)
def test_brackets_are_balanced(spark, texts):
    """What comes out is left alone the second time, unless a number got its opener, or a lone backslash at the end met a closer."""
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("b", repairing.balance_brackets(F.col("t")))
    rows = rows.select("t", "b", repairing.balance_brackets(F.col("b.text")).alias("again"))
    for r in rows.collect():
        if not r.t.endswith("\\") and "restored a missing opening bracket" not in r.b.repairs and "restored a missing opening bracket" not in r.again.repairs:
            assert r.again.text == r.b.text and r.again.repairs == [], r.t


def test_free_names(spark):
    from glyphmill.operators import reports

    taken = [("d", n) for n in ("a.docx", "a_2.docx", "a_4.docx", "b.pdf", "c_2.docx", "e_2.docx", "e_2_2.docx", "x.tar.gz", "a_02.docx")] + [("long", "z.docx")] + [("long", f"z_{i}.docx") for i in range(2, 2500)]
    wanted = [("d", "a", ".docx"), ("d", "b", ".docx"), ("d", "c", ".docx"), ("d", "e_2", ".docx"), ("d", "x", ".tar.gz"), ("long", "z", ".docx"), ("none", "a", ".docx"), ("d", "a", "")]
    w, t = spark.createDataFrame(wanted, "dir string, stem string, suffix string"), spark.createDataFrame(taken, "dir string, name string")
    free = lambda *c: {(r.dir, r.stem, r.suffix): r.name for r in reports.free_names(w, t, *c).collect()}
    got = free()
    assert [got[x] for x in wanted] == ["a_3.docx", "b.docx", "c.docx", "e_2_3.docx", "x_2.tar.gz", "z_2500.docx", "a.docx", "a"]
    assert free((".pdf",))["d", "b", ".docx"] == "b_2.docx"


@pytest.mark.parametrize(("url", "allowed"), [("http://10.example.com/v1", False), ("http://127.evil.org", False), ("http://[::1]:1/x", True), ("http://169.254.0.1", True), ("http://172.32.0.1", False), ("http://172.31.0.1/a", True), ("http://10.0.0.256", False), ("http://[2001:db9::1]", False), ("http://[fd00::2]/", True), ("https://10.example.com", True), (None, False)])
def test_endpoints(spark, url, allowed):
    from glyphmill.operators import reports

    assert spark.createDataFrame([(url,)], "u string").select(reports.endpoint_allowed(F.col("u")).alias("x")).first().x is allowed


def test_expectations_with_other_blanks(spark):
    df = spark.createDataFrame([("E [x　= E [y]",), ("E[x = E[y]",)], "t string")
    assert [r[0] for r in df.select(repairing.close_expectations(F.col("t"))).collect()] == ["E [x]　= E [y]", "E[x] = E[y]"]
