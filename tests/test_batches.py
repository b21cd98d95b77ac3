import os

import pytest

from glyphmill import api
from glyphmill.streaming import batches
from test_words import MATH, docx


def test_arrivals(spark, tmp_path):
    at, out, status, check = (str(tmp_path / n) for n in ("in", "out", "status", "check"))
    os.makedirs(at)
    put = lambda name, data: open(f"{at}/{name}", "wb").write(data)
    put("a.docx", docx("one $x$"))
    put("b.DOCM", docx("two $y$ and $z$"))
    put("bad.docx", b"no zip")
    put("c.tex", b"\\frac12 and \xff")
    put("skipped.txt", b"\\frac12")
    calls = []

    def compiler(tex):
        return MATH

    own = api.repair_words
    api.repair_words = lambda *a, **k: calls.append(k["only"]) or own(*a, **k)
    try:
        run = lambda **k: {(r.path.rpartition("/")[2], r.digest): r for r in batches.repair_arrivals(spark, at, out, status, check, compiler, at_once=10, **k).collect()}
        first = run()
        assert {n: (r.kind, r.status, r.converted) for (n, _), r in first.items()} == {"a.docx": ("word", "completed", 1), "b.DOCM": ("word", "completed", 2), "bad.docx": ("word", "failed", 0), "c.tex": ("tex", "completed", 1)}
        assert open(f"{out}/c.tex", encoding="utf-8").read() == "\\frac{1}{2} and �" and "read" in next(r.error for (n, _), r in first.items() if n == "bad.docx")
        assert calls == [["a.docx", "b.DOCM", "bad.docx"]]
        assert run() == first and len(calls) == 1  # nothing new
        os.rename(check, check + ".lost")  # the stream starts anew, the table still knows
        again = run()
        assert calls[1:] == [["bad.docx"]] and again.keys() == first.keys()
        put("a.docx", docx("one $x$ and $w$"))
        put("d.docx", docx("$v$"))
        last = run(recheck=True)
        assert calls[2:] == [["d.docx"], ["a.docx", "bad.docx"]] and len(last) == 6
        s = batches.summary(batches.completed(spark, status)).first()
        assert (s.completed, s.failed) == (4, 1)
    finally:
        api.repair_words = own


def test_a_compiler_is_needed(spark):
    with pytest.raises(api.NotAvailable):
        batches.repair_arrivals(spark, "a", "b", "c", "d")
