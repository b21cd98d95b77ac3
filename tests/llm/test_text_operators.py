"""Secrets, personal data, quality statistics, records, pieces and mixing against plain versions."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import mixing, pieces, pii, quality, records, secrets, trigrams

ODD = [None, "", " ", "\n", "é😀", "x" * 60_000, "a b " * 4000]


def docs(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, spans string, size int")


# --- secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base_secrets(t):
    t = t or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def test_secrets(spark):
    rng = random.Random(4)
    parts = ["password", "PASSWD", "Token", "api_key", "apikey", ":", "=", " ", '"', "'", "abc", "AKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef", "é", "😀", "\n", "secret=abcdefg"]
    texts = [*ODD, *("".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(400)), "token=abcdef", "token=abcdef"]
    rows = secrets.scan(docs(spark, texts).select("doc_id", "text")).select("doc_id", secrets.listed(F.filter("spans", lambda s: s.kind.isin("assign", "access", "hex"))).alias("s")).collect()
    assert len(rows) == len(texts)
    assert all(r.s == ",".join(base_secrets(texts[r.doc_id])) for r in rows)


def test_secret_repeats_and_redaction(spark):
    same = "x token=abcdef y"
    rows = [(1, same, 7, 3, "s", None), (1, same, 7, 3, "s", None), (1, "token=ghijkl", 8, 3, "s", None), (2, None, 7, 3, "s", None), (3, "fine", 9, 3, "s", None), (None, same, 1, 3, "s", None), (None, "hex " + "0a" * 12, 1, 3, "s", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int, bucket int, spans string, near boolean")
    out = secrets.redact(df, counted="bucket")
    assert out.columns == df.columns
    want = [(1, "x [SECRET] y", 7, 12, "s", None)] * 2 + [(1, "[SECRET]", 8, 8, "s", None), (2, None, 7, 3, "s", None), (3, "fine", 9, 3, "s", None), (None, "x [SECRET] y", 1, 12, "s", None), (None, "hex [SECRET]", 1, 12, "s", None)]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert secrets.scan(df.where("false").select("doc_id", "text")).count() == 0


def test_texts_of_one_id_keep_their_own_spans(spark):
    df = spark.createDataFrame([(i % 2 or None, f"token=abcdef{'x' * i}") for i in range(12)], "doc_id long, text string")
    assert sorted(r.spans[0].end for r in secrets.scan(df).collect()) == [12 + i for i in range(12)]


def test_scan_is_native(spark):
    plan = secrets.scan(docs(spark, ["token=abcdef"]).select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("pattern", [r.pattern for r in secrets.RULES] + ["abc|abd", "a(bc)+d", "(?:xy){2}z?", "ab.cd", "[ab]cd", "a*"])
def test_trigram_queries_are_necessary(pattern):
    need, rng = trigrams.query(pattern), random.Random(7)
    parts = sorted(set(re.findall(r"[A-Za-z_-]{2,}", pattern))) + list("abcdxyz=:'\" 0123456789_.@-/")
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(1, 9)))
        if re.search(pattern, t, re.A):
            low = t.lower()
            assert trigrams.holds(need, {low[i : i + 3] for i in range(len(low))})
    assert trigrams.query("[0-9a-f]{24,}") is None and trigrams.query("hello") == ("and", "hel", "ell", "llo")


# --- personal data

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def base_pii(t):
    out = [(0, m.start(), m.end()) for m in EMAIL.finditer(t)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        s = re.sub("[ -]", "", m[0])
        if 13 <= len(s) <= 19 and sum(sum(divmod(2 * int(x), 10)) if i % 2 else int(x) for i, x in enumerate(s[::-1])) % 10 == 0:
            out.append((2, m.start(), m.end()))
    return out + [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.findall("[0-9]", m[0])) <= 15]


def test_base_spans():
    rng = random.Random(2)
    parts = ["a", "@", ".", "b.c", "-", "1", "23", "256", "0007", "+", "(", " ", "é", "4111111111111111", "1.2.3.4", "+1 (743) 555-3824", "x@y.z", "٣"]
    for _ in range(8000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(s) == base_pii(s), s
    assert pii.base_spans("a" * 200_000 + "@" + "1" * 200_000) == []


def card(i):
    """A number of 16 digits that passes Luhn."""
    head = f"4{i:014d}"
    return next(head + str(d) for d in range(10) if pii.luhn(head + str(d)))


def planted():
    """Seeds certify "account number _"; the codes found there certify "billed to _", where seeds never stand; 777-0001 stands there alone."""
    texts = [f"see account number {card(i)} end" for i in range(40)]
    texts += [f"my account number 55-{100 + i}, please" for i in range(6)]
    texts += [f"account number {card(50 + i)} and billed to {card(70 + i)} now" for i in range(9)]
    texts += [f"order {i}: billed to 55-{100 + i} yes" for i in range(6)] + ["order 9: billed to 777-0001 yes"] * 2
    texts += [f"page {1000 + i} of the book" for i in range(20)] + ["clash 999-111 here", None, "", "x" * 60_000 + " 123456 " + "y" * 60_000]
    return texts


def test_patterns_find_what_seeds_never_met(spark):
    texts = planted()
    rows = {r.doc_id: r for r in pii.extract(docs(spark, texts).select("doc_id", "text")).collect()}
    found = {i: [texts[i][s.start : s.end] for s in r.found] for i, r in rows.items() if r.found}
    assert len(rows) == len(texts)
    assert all(found[i] == [f"55-{60 + i}"] for i in range(40, 46)), "known by a pattern that seeds certify"
    assert all(found[i] == [f"55-{45 + i}"] for i in range(55, 61)), "their other places"
    assert found[61] == found[62] == ["777-0001"], "known by a pattern that found values certify"
    assert set(found) == {*range(40, 46), *range(55, 63)}


def test_rounds_end_when_nothing_new_is_found(spark):
    """Seven generations: the codes of each stand in the words of the next, whose other codes stand nowhere else."""
    words = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel"]
    place = lambda w, code: f"{w}one {w}two {code} {w}three {w}four"  # noqa: E731  no word is shared between generations
    texts = [f"see {place('alpha', card(i))}" for i in range(40)]
    for g, w in enumerate(words):
        texts += [f"{k} {place(w, f'{1000 * g + 100 + i}-{i}')}" for i in range(8) for k in ("we", "they")]  # its own
        texts += [f"we {place(words[g + 1], f'{1000 * g + 100 + i}-{i}')}" for i in range(8)] if g + 1 < len(words) else []
    values = {r.value for r in pii.bootstrap(pii.scan(docs(spark, texts).select("doc_id", "text")), 0.3, 5)[1].collect()}
    assert values == slow_bootstrap(texts, 99, 0.3, 5)[1] and len(values) >= 64
    assert len(slow_bootstrap(texts, 4, 0.3, 5)[1]) < len(values), "more than four rounds"


def slow_bootstrap(texts, rounds, confidence, support):
    """Patterns, and known values beside seeds, by plain loops."""
    of, where, seeds = {}, {}, set()
    for t in texts:
        for x in pii._tokens(t or "", pii.base_spans(t or "")):
            seeds |= {x["value"]} if x["seed"] else set()
            for p in x["patterns"]:
                of.setdefault(p, set()).add(x["value"])
                where.setdefault((p, x["value"]), set()).add(t)
    known = set(seeds)
    for _ in range(rounds):
        good = {}
        for p, values in of.items():
            hit = values & known
            texts_of = {min(pii.xxhash.xxh64_intdigest(t.encode()) for t in where[p, v]) for v in hit}
            if len(hit) >= support and len(texts_of) > 1 and pii.plain_lower_bound(len(hit), len(values)) >= confidence:
                good[p] = pii.plain_lower_bound(len(hit), len(values))
        miss = {}
        for p, s in good.items():
            for v in of[p]:
                miss[v] = miss.get(v, 1.0) * (1 - s)
        then = seeds | {v for v, m in miss.items() if 1 - m >= confidence}
        if len(then) == len(known):
            known = then
            break
        known = then
    return good, known - seeds


def test_scores_against_plain_loops(spark):
    rng = random.Random(9)
    words, codes = ["card", "no", "of", "the", "ref"], [f"{rng.randrange(10**5):05d}-{i}" for i in range(25)]
    texts = [" ".join(rng.choice([*words, *words, card(rng.randrange(30)), rng.choice(codes), "\n"]) for _ in range(rng.randint(2, 25))) for _ in range(120)]
    texts += ["card " + card(i) for i in range(30)] + ["no " + card(i) + " of" for i in range(30)] + [texts[0], *ODD]
    confidence, support = 0.5, 3
    patterns, found = pii.bootstrap(pii.scan(docs(spark, texts).select("doc_id", "text")), confidence, support)
    good, values = slow_bootstrap([t for t in texts if t], 99, confidence, support)
    got = {r.pattern: r.score for r in patterns.collect()}
    assert got.keys() == good.keys() and all(abs(got[p] - good[p]) < 1e-9 for p in good) and good
    assert {r.value for r in found.collect()} == values


def test_words_with_many_spans_are_read_once():
    t = "x1.2.3.4" * 60_000
    assert len(pii._tokens(t, pii.base_spans(t))) == len(pii.base_spans(t)) > 1


def test_pii_of_odd_tables(spark):
    plain = spark.createDataFrame([(1, "number 12-34"), (1, "number 12-34"), (None, "at 1.2.3.4")], "doc_id long, text string")
    rows = pii.extract(plain).collect()
    assert [r.found for r in rows] == [[], [], []] and sorted(len(r.base) for r in rows) == [0, 0, 1] and pii.extract(plain.where("false")).count() == 0


# --- quality


def slow_statistics(t):
    t = t or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    marked = {i + d for v in seen.values() if len(v) > 1 for i in v for d in range(3)}
    lines, dup, known = t.split("\n"), 0, set()
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in known
            known.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(marked)


def test_statistics(spark):
    rng = random.Random(3)
    texts = [*ODD, *("".join(rng.choice(["a ", "b ", "c", " ", "\n", "#", "|", "é", "\x1c", " "]) for _ in range(rng.randint(1, 60))) for _ in range(300))]
    rows = quality.statistics(docs(spark, texts)).collect()
    assert all((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == slow_statistics(texts[r.doc_id]) for r in rows) and len(rows) == len(texts)


def test_decision_list():
    rng = np.random.default_rng(1)
    n = 1500
    x = {"a": rng.random(n), "b": rng.random(n), "c": rng.random(n)}
    bad = ((x["a"] > 0.8) & (x["b"] < 0.5)) | (x["c"] > 0.95)
    rules = quality.learn(x, bad ^ (rng.random(n) < 0.03))
    said = np.logical_or.reduce([r.holds(x) for r in rules])
    assert (said == bad).mean() > 0.95 and len(rules) <= 12
    assert quality.learn(x, np.zeros(n, dtype=bool)) == []


def test_verdict_without_rules(spark):
    assert spark.range(1).select(quality.verdict([]).alias("v")).first().v is True


# --- records


def test_frames():
    f = records.frame(b"abc") + records.frame(b"")
    p, at = records.unframe(f)
    assert bytes(p) == b"abc" and bytes(records.unframe(f, at)[0]) == b""
    for i in range(len(records.frame(b"abc"))):
        bad = bytearray(records.frame(b"abc"))
        bad[i] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(bad))


def test_encoder_is_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    e, rng = records.Encoder(path, 2, remember=50), random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "bc", "é", "'s", "1", "\x1c", "\x85", "\xa0", "!", "<|endoftext|>", "\0", "😀"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    for at in range(0, len(texts), 100):
        for s, ids in zip(texts[at : at + 100], e.encode(texts[at : at + 100])):
            assert ids[:-1].tolist() == t.encode(s, add_special_tokens=False).ids and ids[-1] == 2


def test_special_tokens_as_the_library_takes_them():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, rng = Tokenizer.from_file(path), random.Random(2)
    parts = [" ", "  ", "\n", "a", "bc", "!", "<|endoftext|>", "é"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    for s, ids in zip(texts, records.encoder(path, 2).encode(texts)):
        assert ids[:-1].tolist() == t.encode(s, add_special_tokens=False).ids and ids[-1] == 2


def test_round_trip(spark, tmp_path):
    path, folder = public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/r"
    texts = [*ODD, "same", "same"]
    unnamed = spark.createDataFrame([(None, "no id"), (None, None)], "doc_id long, text string")
    df = docs(spark, texts, 5).unionByName(docs(spark, ["same"], 12)).select("doc_id", "text").unionByName(unnamed)
    manifest = records.write(df, folder, path, shard_bytes=2000)
    rows = sorted(records.read_digests(folder, manifest).collect(), key=lambda r: r.start)
    e, start = records.Encoder(path, 2), 0
    want = [(None, ""), (None, "no id"), *sorted([(5 + i, t or "") for i, t in enumerate(texts)] + [(12, "same")])]
    for r, (i, t) in zip(rows, want, strict=True):
        ids = e.encode([t])[0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
        start += len(ids)
    shards = [(m.name, m.width) for m in manifest.collect()]
    read = list(records.shuffled(folder, shards, 3, at_once=2))
    assert len(shards) > 2 and sorted((i or -1) for i, _ in read) == sorted((i or -1) for i, _ in want)
    assert [i for i, _ in read] != [i for i, _ in want] and sum(len(x) for _, x in read) == start
    assert struct.calcsize("<QQ") == 16
    empty = records.write(df.where("false"), f"file://{tmp_path}/e", path)
    assert records.read_digests(f"file://{tmp_path}/e", empty).count() == 0


# --- pieces


@pytest.fixture(scope="module")
def sampler():
    return pieces.Sampler(public_tokenizers.path("piece_bpe_32k.model"), 3)


def all_paths(lat, node):
    if node < 0:
        return [((), 0.0)]
    first = int(lat.first_edge.data[node])
    out = []
    for e in range(first, first + int(lat.n_edges.data[node])):
        out += [((e, *p), q + float(lat.edge_log.data[e])) for p, q in all_paths(lat, int(lat.edge_to.data[e]))]
    return out


def test_samples_are_gumbel_top_k(sampler):
    (starts,) = sampler.lattices.starts([pieces.units_of("the cat")])
    lat = sampler.lattices
    paths = [(p + q, a + b) for p, a in all_paths(lat, int(starts[0])) for q, b in all_paths(lat, int(starts[1]))]
    p = np.exp([lp for _, lp in paths])
    assert abs(p.sum() - 1) < 1e-5
    place, n = {e: i for i, (e, _) in enumerate(paths)}, 6000
    first, weighed, seen = np.zeros(len(p)), np.zeros(len(p)), np.zeros(len(p))
    for found in sampler.sample([starts] * n, [f"k{i}".encode() for i in range(n)]):
        assert len({tuple(e.tolist()) for e, *_ in found}) == 3 and [g for _, _, g, _ in found] == sorted((g for _, _, g, _ in found), reverse=True)
        first[place[tuple(found[0][0].tolist())]] += 1
        for e, lp, _, inc in found:
            weighed[place[tuple(e.tolist())]] += np.exp(lp) / inc
            seen[place[tuple(e.tolist())]] += 1
    rng = np.random.default_rng(0)
    sim = np.zeros(len(p))
    for _ in range(n):
        sim[np.argsort(-(np.log(p) + rng.gumbel(size=len(p))))[:3]] += 1
    assert np.abs(first / n - p).max() < 0.02 and np.abs(weighed / n - p).max() < 0.03 and np.abs(seen - sim).max() / n < 0.03


def test_round_trip_of_pieces(spark, sampler):
    texts = [*ODD, "  two  blanks ", "漢字 かな\n\tx", "▁literal", "a" * 300]
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = pieces.sampled(docs(spark, texts), path, 3).collect()
    assert all(r.decodes for r in rows) and {r.doc_id for r in rows} == set(range(len(texts)))
    assert rows == pieces.sampled(docs(spark, texts).repartition(3), path, 3).orderBy("doc_id", "sample").collect() or sorted(map(str, rows)) == sorted(map(str, pieces.sampled(docs(spark, texts).repartition(3), path, 3).collect()))
    lib = pieces.encoded(docs(spark, texts), path)
    back = {r.doc_id: r.text for r in pieces.decoded(lib, path).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(texts))
    assert pieces.sampled(docs(spark, texts).where("false"), path).count() == 0


# --- mixing


def slow_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + ([None] if None in sizes else [])
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        level = (total - sum(capped.values())) / max(sum(w[s] for s in free), 1e-300) if free else 0
        over = [s for s in free if w[s] * level > 3 * sizes[s]]
        if not over:
            return {**capped, **{s: w[s] * level for s in free}}
        capped.update({s: 3 * sizes[s] for s in over})


def test_mix(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)) if i % 9 else None, rng.choice(["a", "b", "c", "d", "é", None, ""])) for i in range(400)]
    rows += [(1000, "one two", "tiny"), (1000, "one two", "tiny"), (1001, None, "none")]
    df = spark.createDataFrame([(*r, 3, "z", -1, -2.0, "k") for r in rows], "doc_id long, text string, source string, taken int, low string, size long, target double, _key string")
    out = mixing.mixed(df.select("doc_id", "text", "source")).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, got = slow_targets(sizes), {}
    for r in out:
        got[r.source] = got.get(r.source, 0) + r.taken
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r.size
    assert len(out) == len(rows) and all(abs(got[s] - want[s]) <= 2 for s in sizes)
    again = mixing.mixed(df.select("doc_id", "text", "source").repartition(3)).collect()
    assert sorted((r.doc_id, r.taken) for r in out) == sorted((r.doc_id, r.taken) for r in again)
    copies = mixing.repeated(df)
    assert [tuple(r) for r in copies.select("taken", "low", "size", "target", "_key").distinct().collect()] == [(3, "z", -1, -2.0, "k")]
    assert copies.columns == df.columns and copies.select(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0] == sum(got.values())
    assert mixing.mixed(df.where("false").select("doc_id", "text", "source")).count() == 0


def test_mix_order_against_plain_loops(spark):
    """Keys, their order and prefix sums, one by one."""
    rng = random.Random(8)
    rows = [(i if i % 11 else None, " ".join(rng.choice(["w", "x#", "!"]) for _ in range(rng.randint(0, 30))), "abc"[i % 3]) for i in range(200)]
    rows += [rows[4]] * 3
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in "abc"}
    goals, want = slow_targets(sizes), {}

    def key(i, t):
        h = int(hashlib.md5(f"1:{'null' if i is None else i}:{t}".encode()).hexdigest()[:15], 16)
        worth = max(0.05, 1 - 2 * len(re.findall("[#*$%&|<>!]", t)) / max(len(t), 1))
        return -np.log((h + 0.5) / 2.0**60) / worth, h

    for s in "abc":
        epochs, budget, groups = int(goals[s] // sizes[s]), int(goals[s] - goals[s] // sizes[s] * sizes[s]), {}
        for i, t, x in rows:
            if x == s:
                groups.setdefault((key(i, t), i, t), []).append(1)
        for (_, i, t), m in sorted(groups.items(), key=lambda g: g[0][0]):
            n = len(t.split())
            part = min(n, max(0, budget) // len(m))
            want[i, t, s] = epochs * n + part
            budget -= n * len(m)
    assert all(r.taken == want[r.doc_id, r.text, r.source] for r in got) and len(got) == len(rows)


def test_small_ranges_are_refined(spark):
    df = spark.createDataFrame([(i, "a b c", "s" if i % 3 else "t", 0) for i in range(300)], "doc_id long, text string, source string, x int").drop("x")
    sized = mixing.measured(df)
    a = {r.source: (r.end_key, r.part) for r in mixing.thresholds(sized, most_rows=1).collect()}
    b = {r.source: (r.end_key, r.part) for r in mixing.thresholds(sized, most_rows=10**6).collect()}
    assert a == b


def test_digest_is_over_kinds_in_order(spark):
    t = "x@y.z 1.2.3.4 +1 (743) 555-3824"
    r = pii.extract(docs(spark, [t]).select("doc_id", "text")).select(F.sha2(pii.listed(F.col("base")), 256).alias("h")).first()
    assert r.h == hashlib.sha256(b"email:0:5,ip:6:13,phone:14:31").hexdigest()
