import random

import numpy as np
import pytest
import xxhash

from glyphmill.llm import graph, simhash

DOCS = "doc_id long, text string, fingerprint string, component_id string"  # clashing names


def slow(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, fps, tau=4):
    up = list(range(len(ids)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= tau:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(ids)):
        least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return [least[root(i)] for i in range(len(ids))]


def corpus():
    rng = random.Random(1)
    base = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rng.randint(0, 30)) for _ in range(300)) for _ in range(8)]
    rows = [(0, None), (1, ""), (2, " \t"), (3, "one"), (4, "One"), (5, "a b c d"), (6, "é  x y"), (7, "x" * 50_000)]
    for k in range(60):
        w = base[k % 8].split()
        for _ in range(k % 5):
            w[rng.randrange(len(w))] = "edit"
        rows.append((100 + k, " ".join(w)))
    return [*rows, rows[3], rows[10]]


def test_against_brute_force(spark):
    rows = corpus()
    got = simhash.near_duplicates(spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS).select("doc_id", "text")).collect()
    fps = [slow(t) for _, t in rows]
    want = sorted(zip((i for i, _ in rows), (f"{f:016x}" for f in fps), components([i for i, _ in rows], fps)))
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


def test_whole_components_of_random_fingerprints(spark):
    """Chains and dense balls, small blocks: hot buckets are dealt out and nothing is lost."""
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 1 << 63))
    fps = [centre]
    for _ in range(400):
        fps.append(fps[-1 if rng.random() < 0.3 else rng.integers(0, len(fps))] ^ int(sum(1 << int(b) for b in rng.integers(0, 63, rng.integers(1, 5)))))
    fps += [int(x) for x in rng.integers(0, 1 << 63, 200)]
    rows = spark.createDataFrame(list(enumerate(fps)), "doc_id long, fp long")
    got = {r.fp: r.component_id for r in simhash.near_components(rows, 4, block=8).collect()}
    want = components(list(range(len(fps))), fps)
    assert all(got[f] == c for f, c in zip(fps, want))


def test_plan_covers_every_pair():
    rng = np.random.default_rng(5)
    for n in (100, 100_000, 10**9):
        both = np.full((64, 64), n // 4)
        np.fill_diagonal(both, n // 2)
        parts = simhash.plan(both, n, 4)
        assert sorted(b for g, _ in parts for b in g) == sorted(set(b for g, _ in parts for b in g))
        for _ in range(300):
            bits = set(rng.choice(64, 4, replace=False).tolist())
            assert any(len(bits & set(g)) <= t for g, t in parts)


def test_one_of_each(spark):
    a, b, c = "a b c d e", "q r s t u v", "one other text of words"
    rows = [(2, a, 1, "k"), (1, a, 1, "k"), (1, a, 1, "k"), (1, b, 1, "k"), (5, a, 2, "k"), (5, c, 2, "k"), (9, b, 3, None), (None, a, 4, "k"), (None, "zz", 4, "k"), (None, "zz", 5, "k"), (None, "zz", 5, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int, component string")
    kept = simhash.one_of_each(df)
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert kept.columns == df.columns and sorted(got, key=str) == sorted([(1, a), (1, b), (5, c), (None, "zz")], key=str)
    assert simhash.one_of_each(df.where("false")).count() == 0


def test_links_through_rows_without_an_id(spark):
    """Fingerprints 0, 15 and 255: the middle one has no id and links the others; 1 << 40 with others of its kind alone is far from all."""
    rows = spark.createDataFrame([(4, 0), (None, 15), (7, 255), (None, (1 << 40) * 1023), (4, 0)], "doc_id long, fp long")
    got = {r.fp: r.component_id for r in simhash.near_components(rows, 4).collect()}
    assert got == {0: 4, 15: 4, 255: 4, (1 << 40) * 1023: None}


def test_empty(spark):
    rows = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(rows).count() == 0


@pytest.mark.parametrize("n", [1, 40])
def test_chain(spark, n):
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(3, 3)], "a long, b long")
    got = {r.node: r.component for r in graph.components(links).collect()}
    assert got == {i: 0 for i in range(1, n + 1)}
