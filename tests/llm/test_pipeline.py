import corpus_pipeline
from glyphmill.llm import queries


def test_run(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    at, sizes = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns, name
        at = spark.createDataFrame(at.toPandas(), docs.schema)
        sizes.append(at.count())
    assert sizes[0] > 190 and sizes[1] <= sizes[0] and sizes[2] == sizes[1]
    assert at.where("text rlike 'token = \"[0-9a-f]{24}'").count() == 0
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.where("not decodes").count() == 0 and out.select("doc_id").distinct().count() > 100


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size int, rejected boolean, key string, spans string"


def odd_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120).select("doc_id", "text", "lang", "source", "n_chars").collect()
    rows = [(*r, 1, False, "k", "s") for r in docs]
    rows += [rows[0], rows[0], (None, rows[1][1], None, None, 3, 1, True, "k", "s"), (10**6, None, "en", "web", 0, 1, True, None, "s"), (10**6 + 1, "", "en", None, 0, 1, None, "k", "s")]
    rows += [(10**6 + 2, rows[2][1] * 40 + " token = \"" + "ab12" * 8 + "\"", None, "web", None, 1, True, "k", None)]
    return spark.createDataFrame(rows, COLUMNS)


def test_stages_take_odd_tables(spark, tmp_path):
    df, names = odd_documents(spark), corpus_pipeline.COLUMNS
    kept = [tuple(r) for r in corpus_pipeline.language(spark, df, "").collect()]
    assert kept and all(r[1] for r in kept) and sum(r[0] is None for r in kept) == 1 and sum(r[0] == df.first().doc_id for r in kept) == 3
    apart = corpus_pipeline.near_duplicates(spark, df, "").collect()
    assert len(apart) == len(set(map(tuple, apart))) and sum(not r.text for r in apart) == 1 and not any(r.doc_id is None for r in apart)
    clean = corpus_pipeline.secret_scan(spark, df, "")
    assert clean.columns == names and clean.count() == df.count() and clean.where("text like '%ab12ab12%'").count() == 0 and clean.where("n_chars is null").count() == 0
    mixed = corpus_pipeline.mix(spark, df, "")
    assert mixed.columns == names and mixed.where("text is null or text = ''").count() == 0
    parts = corpus_pipeline.segment(spark, df, "")
    assert parts.where("not decodes").count() == 0 and parts.where("n_tokens = 0").count() == 2
    empty = df.where("false")
    assert all(stage(spark, empty, "").count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_every_operator_has_a_query():
    assert [q.split("_")[0] for q in queries.queries()] == [f"op{n}" for n in range(1, 14)]
