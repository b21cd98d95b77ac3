import math

import numpy as np
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from glyphmill.llm import topk


def brute(rows, k, every=20):
    v = {}
    live = []
    for i, e in rows:
        if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            live.append((i, [math.floor(64 * x) for x in e]))
    for i, e in live:
        if i % every == 0 and i not in v:
            v[i] = sorted(((-sum(a * b for a, b in zip(e, f)), j) for j, f in live if j != i))[:k]
    return sorted((q, r + 1, j, -s) for q, best in v.items() for r, (s, j) in enumerate(best))


def run(spark, rows, k):
    df = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").select("vec_id", "embedding"))
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df.where("vec_id % 20 = 0"), df, k).collect())


@pytest.mark.parametrize(("dims", "spread"), [(1, 1.0), (7, 3.0), (40, 200.0)])
def test_against_brute_force(spark, dims, spread):
    rng = np.random.default_rng(dims)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, spread, dims)], "x") for i in range(150)]
    rows += [(200, None, "x"), (220, [float("nan")] * dims, "x"), (240, [float("inf")] + [0.0] * (dims - 1), "x"), (260, [None] * dims, "x"), (None, [1.0] * dims, "x")]
    rows += [(300 + i, rows[i][1], "x") for i in range(30)]  # ties
    rows += [rows[5]]
    assert run(spark, rows, 20) == brute([r[:2] for r in rows], 20)


def test_few_and_none(spark):
    assert run(spark, [(0, [1.0], "x"), (1, [2.0], "x")], 20) == [(0, 1, 1, 64 * 128)]
    assert run(spark, [(1, [1.0], "x")], 20) == [] and run(spark, [(20, [], "x"), (21, [], "x")], 5) == [(20, 1, 21, 0)]


def test_blocks_and_wide_values():
    rng = np.random.default_rng(0)
    q, c = rng.integers(-(1 << 29), 1 << 29, (33, 6)), rng.integers(-(1 << 29), 1 << 29, (33, 500))
    ids = np.arange(500)
    a, b, s = topk.search((np.arange(1000, 1006), q), (ids, c), 10, block=4)
    exact = [[int(x) for x in row] for row in (q.astype(object).T @ c.astype(object))]
    want = [(1000 + i, j, row[j]) for i, row in enumerate(exact) for j in sorted(range(500), key=lambda j: (-row[j], j))[:10]]
    assert list(zip(a.tolist(), b.tolist(), s.tolist())) == want


@pytest.mark.parametrize("own", [1, 2, 30])
def test_repeated_query_rows(own):
    """Rows of the query's own id outbid all others after the first block."""
    rng = np.random.default_rng(own)
    c = np.zeros((40, 400), dtype=np.int64)
    c[:16] = rng.integers(-100, 100, (16, 400))
    c[:, :own] = np.r_[np.full(16, 1000), np.zeros(24, dtype=np.int64)][:, None]
    ids = np.r_[np.full(own, 20), np.arange(100, 500 - own)]
    a, b, s = topk.search((np.array([20]), c[:, :1]), (ids, c), 20)
    scores = c[:, 0] @ c
    want = sorted((-int(x), int(i)) for x, i in zip(scores, ids) if i != 20)[:20]
    assert list(zip(a.tolist(), b.tolist(), s.tolist())) == [(20, i, -x) for x, i in want]


def test_large_products_are_exact_or_refused():
    big = np.array([[64 * 10**10, 64 * 10**10 - 1]], dtype=np.int64)
    a, b, s = topk.search((np.array([20]), big[:, :1] // 2**20), (np.array([20, 21]), big), 5)
    assert s.tolist() == [int(big[0, 0] // 2**20) * int(big[0, 1])]
    with pytest.raises(OverflowError):
        topk.search((np.array([20]), big[:, :1]), (np.array([20, 21]), big), 5)


def test_tiles_out_of_reach_are_never_paired(spark, monkeypatch):
    """Norms fall off, so the k-th score of the first tile rules most tiles out."""
    monkeypatch.setattr(topk, "CANDIDATE_TILE", 50)
    monkeypatch.setattr(topk, "QUERY_TILE", 16)
    rng = np.random.default_rng(2)
    rows = []
    for i in range(1000):
        v = rng.normal(0, 1, 8)
        rows.append((i, [float(np.float32(x)) for x in v / np.linalg.norm(v) * (40 if i % 10 == 1 else 0.5)], "x"))
    pairs, own = [], topk.tile_pairs
    monkeypatch.setattr(topk, "tile_pairs", lambda *a: pairs.append(own(*a)) or pairs[-1])
    got = run(spark, rows, 5)
    assert got == brute([r[:2] for r in rows], 5)
    q, c = 1000 // 20 // 16, 1000 // 50
    assert pairs[0].count() <= q * c / 2


def test_only_reachable_parts_are_listed(spark, monkeypatch):
    monkeypatch.setattr(topk, "STEPS", 16)
    norms = [100 / (i + 1) for i in range(200)]
    c = spark.createDataFrame([(i, 0, n) for i, n in enumerate(norms)], "part int, seq int, norm double")
    needs = [0.0, 0.5, 1.0, 7.0, 99.0, 101.0, float("-inf")]
    q = spark.createDataFrame([(i, 0, x) for i, x in enumerate(needs)], "part int, seq int, need double")
    got = topk.tile_pairs(q, c, 200)
    assert sorted((r.q_part, r.part) for r in got.collect()) == sorted((i, j) for i, x in enumerate(needs) for j, n in enumerate(norms) if n >= x)
    rows: list = []
    own = DataFrame.join
    monkeypatch.setattr(DataFrame, "join", lambda self, *a, **k: rows.append(self.count()) or own(self, *a, **k))
    topk.tile_pairs(q, c, 200)
    assert rows[0] <= got.count() + 13 * len(needs)  # a group of parts a query tile more, not all 200


def test_saturated_components_are_refused(spark):
    with pytest.raises(Exception, match="beyond 64 bits"):
        run(spark, [(20, [1e18], "x"), (21, [1.0 / 64], "x")], 5)


def test_no_rows(spark):
    assert run(spark, [], 5) == []
    df = topk.quantised(spark.createDataFrame([(1, [1.0], 1, "x"), (20, [1.0], 2, "y")], "vec_id long, embedding array<float>, part int, norm string").select("vec_id", "embedding"))
    assert [tuple(r) for r in topk.top_k(df.where("vec_id = 20"), df, 3).collect()] == [(20, 1, 1, 64 * 64)]
