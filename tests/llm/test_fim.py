import hashlib
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphmill.llm import fim


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n<>PSMé\U0001f600\x00", max_size=60), st.integers(0, 70), st.sampled_from(list(fim.UNITS)), st.integers(1, 9))
def test_ropes_split_at_units(text, k, unit, leaf):
    r = fim.rope(text, unit, leaf)
    units = list(text) if fim.UNITS[unit] is None else fim.UNITS[unit].findall(text)
    assert "".join(units) == text and (r.units, r.points) == (len(units), len(text)) and fim.flat(r) == text
    a, b = fim.split(r, k)
    assert (fim.flat(a), fim.flat(b)) == ("".join(units[:k]), "".join(units[k:]))
    assert a.points + b.points == r.points and fim.flat(fim.joined(b, a)) == "".join(units[k:] + units[:k])


def depth(r):
    return 0 if isinstance(r, fim.Leaf) else 1 + max(depth(r.left), depth(r.right))


def test_splits_share_subtrees():
    r = fim.rope("abcdefgh" * 4096, leaf=8)
    assert depth(r) == 12
    a, b = fim.split(r, 8 * 4096 // 2 + 3)
    assert a.left is r.left and depth(a) <= 13 and depth(b) <= 13


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab<>PSM \n", max_size=40), st.tuples(*[st.integers(0, 2**32 - 1)] * 4), st.sampled_from(list(fim.UNITS)))
def test_round_trip(text, h, unit):
    n, form, i, m, pc, mc, out = fim.made(text, h, unit, 90, 50, fim.SENTINELS)
    assert fim.restored(out, form) == text
    if form == "plain":
        assert out == text and i is None
    else:
        assert len(out) == len(text) + 9 and 0 <= pc <= pc + mc <= len(text) and 0 <= i <= i + m <= n


def test_overlapping_sentinels_are_refused():
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "", "<M>"), ("aba", "<S>", "<M>"), ("ab", "bc", "<M>"), ("xabx", "ab", "<M>")):
        with pytest.raises(ValueError):
            fim.sound(bad)
    fim.sound(fim.SENTINELS)
    with pytest.raises(ValueError):
        fim.restored("<S>a<P>b<M>c", "psm")


ROWS = [(i, "word%d café \U0001f600\n" % i * (i % 7), "x") for i in range(120)]
ROWS += [(None, "no id here", "x"), (500, None, "x"), (501, "", "x"), (502, "holds <S> itself", "x"), (503, "<P", "x"), (504, "a\x00b ", "x"), (505, "long words " * 40_000, "x")]
ROWS += [ROWS[5], ROWS[5]]


def brute(doc_id, text):
    text = text or ""
    s = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(s[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b, z = text[:i], text[i:j], text[j:]
    return (n, "spm", i, j - i, f"<S>{z}<P>{a}<M>{b}") if h[3] % 100 < 20 else (n, "psm", i, j - i, f"<P>{a}<S>{z}<M>{b}")


def test_rows_against_plain_slices(spark, tmp_path):
    docs = spark.createDataFrame([(*r, 1, "o") for r in ROWS], "doc_id long, text string, form string, n int, output string")
    made = fim.transformed(docs)
    got = sorted((r.doc_id or -1, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made.collect())
    assert [(*g[:3], g[5]) for g in got] == sorted((d or -1, b[0], b[1], b[4]) for d, t, _ in ROWS for b in [brute(d, t)])
    assert {g[2] for g in got} == {"plain", "psm", "spm"}
    back = sorted((r.doc_id or -1, r.text) for r in fim.restore(made).collect())
    assert back == sorted((d or -1, t or "") for d, t, _ in ROWS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    own = fim.op11_fill_in_middle(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    sql = con.sql(fim.ORACLE_SQL["op11_fill_in_middle"])
    assert sorted(map(str, map(tuple, own.select(sql.columns).collect()))) == sorted(map(str, sql.fetchall()))
    assert fim.transformed(docs.where("false")).count() == 0 and fim.restore(made.where("false")).count() == 0


@pytest.mark.parametrize("unit", ["words", "lines"])
def test_other_units(spark, unit):
    docs = spark.createDataFrame([r[:2] for r in ROWS], "doc_id long, text string")
    made = fim.transformed(docs, unit=unit, seed=7, rate=100, spm=50)
    for r in fim.restore(made).collect():
        if r.form != "plain":
            units = fim.UNITS[unit].findall(r.text)
            assert r.n == len(units) and r.prefix_chars == len("".join(units[: r.prefix_units]))
            assert r.middle_chars == len("".join(units[r.prefix_units : r.prefix_units + r.middle_units]))
    assert sorted((r.doc_id or -1, r.text) for r in fim.restore(made).collect()) == sorted((d or -1, t or "") for d, t, _ in ROWS)
