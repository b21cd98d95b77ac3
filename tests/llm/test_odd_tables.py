"""Every query over tables with nulls, empty and very long texts, repeated rows, other columns of clashing names; and over empty tables."""

import pytest

from glyphmill.llm import queries

NAMES = "doc_id long, text string, lang string, source string, n_chars long, row int, piece string, score double, words string, size int, rid string, form string, found string, ids string, part string, length string, h0 long, lang_pred string"
EMBEDDED = "vec_id long, embedding array<float>, label int, part int, seq int, norm string, pivot string, lo string, key string, rank int, score double"


def document(doc_id, text, lang="en", source="web"):
    return (doc_id, text, lang, source, 3, 1, "x", 0.5, "w", 1, "r", "f", "y", "i", "p", "l", 7, "z")


def vector(i, v, label):
    return (i, v, label, 1, 2, "n", "p", "l", "k", 3, 0.5)


DOCS = [document(i, f"some words of text number {i} with a token = \"{'ab12' * 7}\" and a@b.cd, 1.2.3.4\nline {i % 3}") for i in range(30)]
DOCS += [document(5, DOCS[5][1])] * 2 + [document(None, "no id at all"), document(None, None), document(100, None, None, None), document(101, ""), document(102, " \n\t "), document(103, "\x00\x85 nul"), document(104, "word " * 100_000, "de")]
VECTORS = [vector(i, [float(i % 7), 1.0, -float(i % 3)], i % 2) for i in range(60)] + [vector(7, [0.0, 1.0, 2.0], 0), vector(None, [1.0] * 3, 1), vector(100, None, 1), vector(120, [None, 1.0, 2.0], 1), vector(150, [1.0, 2.0, 3.0], None), vector(200, [], 1)]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("odd")
    docs, vectors = spark.createDataFrame(DOCS, NAMES), spark.createDataFrame(VECTORS, EMBEDDED)
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 1), "t") for i in range(30)] + [(None, None, None, "t"), (3, 1, 1, "t")], "doc_id long, quality int, toxic int, text string")
    for name, keep in (("full", "true"), ("empty", "false")):
        for table, df in (("documents", docs), ("embeddings", vectors), ("labels", labels)):
            df.where(keep).write.parquet(f"{at}/{name}/{table}.parquet")
    return at


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, folders, name):
    run = queries.queries()[name]
    rows = run(spark, f"{folders}/full").collect()
    number = int(name[2:].split("_")[0])
    if number in (1, 13):
        assert rows and {r.query_id if number == 1 else r.anchor_id for r in rows} <= {0, 20, 40, 50, 100, 200}
    elif number == 12:
        assert sum(r.piece == 0 for r in rows) == len(DOCS) and sum(r.doc_id is None for r in rows) == 2
    elif number == 3:
        assert {r.doc_id for r in rows} == {d[0] for d in DOCS}
    else:
        assert len(rows) == len(DOCS) and sorted(str(r.doc_id) for r in rows) == sorted(str(d[0]) for d in DOCS)
    one = [tuple(x for k, x in r.asDict().items() if k not in ("start", "sequence_id", "offset", "taken")) for r in rows if number not in (1, 3, 12, 13) and r.doc_id == 5]
    assert all(x == one[0] for x in one), "repeated rows come to the same"
    assert run(spark, f"{folders}/empty").count() == 0
