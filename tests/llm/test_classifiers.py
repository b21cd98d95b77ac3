import random

import numpy as np
import pytest

from glyphmill.llm import langid, quality, toxicity

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model():
    rng = random.Random(0)
    words = {"en": "the and ing ed th ly".split(), "de": "der und ung ich sch keit".split(), "fr": "le et eau ment que ou".split()}
    rows = [(" ".join("".join(rng.choice(w) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 60))), lang) for lang, w in words.items() for _ in range(80)]
    return langid.train(rows)


def test_language(model):
    names, scores, rejected = model.predict(["the and thing", "der und ung", "le eau ment", None, "", "123 !?", "the " * 30_000])
    assert names == ["en", "de", "fr", "und", "und", "und", "en"]
    assert (scores >= 0).all() and (scores <= 1).all() and list(rejected[3:6]) == [True] * 3 and not rejected[0]


def test_nothing_to_learn():
    assert langid.train([]).predict(["abc", None])[0] == ["und", "und"]


def test_predictions_do_not_depend_on_batches(model):
    texts = ["the and", "der und keit", "le et"] * 50
    a, b = model.predict(texts), [model.predict([t]) for t in texts]
    assert a[0] == [x[0][0] for x in b] and np.allclose(a[1], [x[1][0] for x in b])


def test_held_out_languages(spark):
    q = langid.op5_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (q.lang == q.lang_pred).mean() > 0.97 and q.rejected.mean() < 0.01


def test_keep_known(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(10**7, None, "en", "s", 0), (10**7 + 1, "12 34", "en", "s", 5)], docs.schema)
    kept = langid.keep_known(docs.unionByName(odd))
    assert kept.columns == docs.columns and kept.where("doc_id >= 10000000").count() == 0 and kept.count() > 0.99 * docs.count()


def test_only_letters_count(model):
    assert model.predict(["²", "½ ①", "Ⅷ", "_ 5", "ª", "漢"])[0][:4] == ["und"] * 4
    assert "und" not in model.predict(["ª", "漢"])[0]


def slow_logits(grams, text, table, bias):
    """Every gram of a text, one by one."""
    data = b" " + b" ".join(text.lower().split()) + b" "
    total, n = np.zeros(table.shape[1]), 0
    for size in grams.sizes:
        for at in range(len(data) - size + 1):
            g = data[at : at + size]
            if b" " in g[1:-1] or g == b"  ":
                continue
            h = 0
            for c in g:
                h = (h * 0x01000193 + c + 1) & 0xFFFFFFFF
            h = ((h ^ (h >> 15)) * 0x9E3779B1 + size & 0xFFFFFFFF) >> (32 - grams.bits)
            total, n = total + table[h], n + 1
    return total / max(n, 1) + bias


def test_scores_of_texts_against_plain_loops(model):
    rng = random.Random(4)
    texts = ["".join(rng.choice("aeé ñt\n") for _ in range(rng.randint(1, 40))).encode() for _ in range(60)] + [b"a", b"x y", b"   "]
    got = langid.subword.text_logits(model.grams, texts, model.table, model.bias)
    assert np.allclose(got, [slow_logits(model.grams, t, model.table, model.bias) for t in texts], atol=1e-4)


def test_worst_runs_against_plain_loops():
    rng = random.Random(6)
    rows = [(" ".join(rng.choice(["idiot", "clown", "of", "the", "sun", "moon"][2 * (i % 2 == 0) :]) for _ in range(9)), i % 2) for i in range(60)]
    m = toxicity.train(rows, 0.5, bits=12)
    texts = ["".join(rng.choice(["idiot", "the", "sun", " ", " ", "clow", "n"]) for _ in range(rng.randint(1, 20))) for _ in range(40)]
    table = m.margin[:, None]

    def grams_from(data, blank, stop):
        """Sum and number of the grams that begin at a blank or in the word after it."""
        total, n = 0.0, 0
        for size in m.grams.sizes:
            for at in range(blank, stop):
                g = data[at : at + size]
                if len(g) == size and b" " not in g[1:-1]:
                    total, n = total + slow_gram(m.grams, g, table), n + 1
        return total, n

    def slow_gram(grams, g, table):
        h = 0
        for c in g:
            h = (h * 0x01000193 + c + 1) & 0xFFFFFFFF
        return float(table[((h ^ (h >> 15)) * 0x9E3779B1 + len(g) & 0xFFFFFFFF) >> (32 - grams.bits), 0])

    for t in texts:
        words = t.encode().split()
        data = b" " + b" ".join(words) + b" "
        blanks = [i for i, c in enumerate(data) if c == 32]
        sums = [grams_from(data, a, b) for a, b in zip(blanks, blanks[1:])] if words else []
        width = min(toxicity.WIDTH, len(sums))
        runs = [sum(s for s, _ in sums[i : i + width]) / max(sum(n for _, n in sums[i : i + width]), 1) for i in range(len(sums) - width + 1)] if words else []
        assert np.allclose(m.margins([t.encode()])[0], max(runs) if runs else m.none, atol=1e-4), t


def test_languages_of_odd_tables(spark):
    rows = [(i, "the and thing" if i % 2 else "der und ung", "en" if i % 2 else "de", 1.0, True, "x") for i in range(80)]
    rows += [rows[3], (7, None, "en", 1.0, True, "x"), (None, "the and", None, None, None, None), (8, "", "de", 1.0, True, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, rejected boolean, lang_pred string")
    kept = langid.keep_known(df)
    assert kept.columns == df.columns and kept.where("text is null or text = ''").count() == 0
    assert sorted(map(str, kept.where("doc_id = 3").collect())) == sorted(map(str, df.where("doc_id = 3").collect())) and kept.where("doc_id is null").count() == 1
    assert langid.keep_known(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        langid.predict(df, langid.train([]))


def test_toxicity_of_misspellings():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abdeghilmnorstu") for _ in range(rng.randint(2, 9)))
    bad = ["idiot", "moron", "worthless", "clown"]
    rows = []
    for i in range(500):
        w = [word() for _ in range(rng.randint(5, 120))]
        if i % 4 == 0:
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((" ".join(w), int(i % 4 == 0)))
    m = toxicity.train(rows, 0.25, bits=15)
    hit = m.scores([b"abc idiot def ghi lmn", b"such a worthles thing", b"MORON", b"", b"gentle words only here", b"abc " * 5000 + b"clown"])
    assert hit[0] > 0.5 and hit[1] > hit[4] and hit[2] > 0.5 and hit[5] > 0.5 and hit[3] < 0.5 and hit[4] < 0.5


def test_one_class():
    assert np.allclose(toxicity.train([("a", 0)], 0.0).scores([b"x", b""]), 0, atol=1e-3)


def test_held_out_toxicity(spark):
    d = "/root/testdata/sf0.1"
    q = toxicity.op8_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
    hit = q[q.toxic == 1].predicted.mean()
    assert hit > 0.7 and q[q.toxic == 0].predicted.mean() < 0.06 and q.score.between(0, 1).all()


def test_quality_of_held_out_documents(spark):
    """Rows that taught nothing: crc32(doc_id as text) mod 5 is 0."""
    d = "/root/testdata/sf0.1"
    q = quality.op6_quality_rules(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality"), "doc_id").where("crc32(cast(doc_id as string)) % 5 = 0").toPandas()
    fair = q[~q.base_failed]
    assert fair[fair.quality == 1].kept.mean() > 0.97 and fair[fair.quality == 0].kept.mean() < 0.3 and len(fair) > 50


def test_toxicity_learns_from_all_runs_of_a_text(monkeypatch):
    seen, own = [], toxicity.subword.train
    monkeypatch.setattr(toxicity.subword, "train", lambda bags, y, *a, **b: seen.append(int(y.sum())) or own(bags, y, *a, **b))
    rows = [(f"{'idiot moron ' * 40}{'abcdefgh'[i]}{i}", 1) for i in range(8)] + [(f"gentle words number {i} {'xyz'[i % 3] * 5} {i * 7919}", 0) for i in range(30)]
    kept = sum(y for _, y in toxicity._apart(sorted(rows)))
    toxicity.train(rows, 0.25, bits=15)
    assert seen[0] > 30 * kept


def test_runs_have_the_grams_of_their_words():
    g = toxicity.Grams((3, 4, 5), 14)
    own = np.random.default_rng(0).random(1 << 14) < 0.3
    for t in (b"", b"a", b"  ", b"ab cde fghij\n k lmn op ", "é ü xyzzy".encode()):
        w = t.split()
        ids, begin = toxicity._by_word(g, t, own, 1 << 14)
        for at in range(len(w)):
            for k in (1, 2):
                whole = toxicity.subword.grams_of(g, b" ".join(w[at : at + k]))
                assert sorted(ids[begin[at] : begin[min(at + k, len(w))]]) == sorted(np.where(own[whole], whole, 1 << 14))


def test_every_language_is_learnt(spark):
    """230 languages of an alphabet each: none is left out, and rows are bounded by all of them together."""
    rows = [(i * 230 + n, " ".join(chr(0x4E00 + 40 * n + (i * 7 + k * 3) % 40) * 2 for k in range(12)), f"l{n:03d}") for n in range(230) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learnt, aside = langid.sample(docs, 250, 300, 1000)
    assert {lang for _, lang in learnt} == {f"l{n:03d}" for n in range(230)} and len(learnt) + len(aside) <= 12 * 230
    model = langid.fit(docs, most_rows=1000)
    assert len(model.languages) == 230 and model.grams.bits == 14
    names, _, _ = model.predict([t for _, t, _ in rows[::5]])
    assert np.mean([a == b[2] for a, b in zip(names, rows[::5])]) > 0.9
