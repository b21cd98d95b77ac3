import math

import duckdb
import numpy as np
import pytest

from glyphmill.llm import negatives


def brute(rows, anchors, positives=5, negs=3, scale=256):
    live = {(i, lab, tuple(math.floor(scale * x) for x in e)) for i, e, lab in rows if i is not None and lab is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
    out = []
    for a, la, va in live:
        if a not in anchors:
            continue
        scored = [(-sum(x * y for x, y in zip(va, v)), i, lab) for i, lab, v in live if i != a]
        for s, p, _ in sorted(t for t in scored if t[2] == la)[:positives]:
            ok = sorted(t for t in scored if t[2] != la and 50 * -s <= 100 * -t[0] <= 95 * -s)[:negs]
            out += [(a, p, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(ok)]
    return sorted(out)


def run(spark, rows, anchors, **kw):
    df = negatives.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    return sorted(map(tuple, negatives.hard_negatives(df, df.where(df.vec_id.isin(*anchors)), **kw).collect()))


def clustered(seed, n, dims, labels, spread=0.4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (labels, dims))
    return [(i, [float(np.float32(x)) for x in centres[i % labels] * rng.uniform(0.2, 2) + rng.normal(0, spread, dims)], int(rng.integers(labels))) for i in range(n)]


@pytest.mark.parametrize(("dims", "labels"), [(1, 2), (6, 3), (40, 10)])
def test_against_brute_force(spark, monkeypatch, dims, labels):
    monkeypatch.setattr(negatives, "TILE", 32)
    monkeypatch.setattr(negatives, "ANCHOR_TILE", 8)
    rows = clustered(dims, 300, dims, labels)
    rows += [(1000 + i, rows[i % 20][1], rows[i % 20][2]) for i in range(60)]  # copies: ties
    rows += [(2000, None, 1), (2050, [float("nan")] * dims, 1), (2100, [1.0] * dims, None), (None, [1.0] * dims, 1), (2150, [None] * dims, 0)]
    rows += [rows[5], rows[5]]  # repeated whole
    anchors = [0, 50, 100, 150, 200, 250, 1000, 1050, 2000, 2050, 2100, 2150]
    want = brute(rows, anchors)
    assert run(spark, rows, anchors) == want and want


def test_a_hot_vector(spark, monkeypatch):
    """A third of all rows hold one vector and label: only the ids that can matter reach the tiles."""
    monkeypatch.setattr(negatives, "TILE", 32)
    rows = clustered(1, 200, 5, 4) + [(5000 + i, [1.0, 0.5, 0.0, -1.0, 2.0], 1) for i in range(150)]
    assert run(spark, rows, [0, 50, 5000, 5050]) == brute(rows, [0, 50, 5000, 5050])
    df = negatives.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert negatives.distinct_rows(df, 6).where("vec_id >= 5000").count() == 6


def test_far_tiles_are_not_scanned(spark, monkeypatch):
    """Tight clusters: each anchor's annuli meet few of the tiles, and no pair of tiles is scanned twice."""
    monkeypatch.setattr(negatives, "AT_ONCE", 0)
    monkeypatch.setattr(negatives, "TILE", 20)
    monkeypatch.setattr(negatives, "ANCHOR_TILE", 2)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(1200):
        centre = np.eye(12)[i % 12] * 8
        rows.append((i, [float(np.float32(x)) for x in centre + rng.normal(0, 0.05, 12)], i % 24 // 12))
    found, own = [], negatives.interval_pairs
    monkeypatch.setattr(negatives, "interval_pairs", lambda *a: found.append(own(*a)) or found[-1])
    anchors = list(range(0, 1200, 50))
    assert run(spark, rows, anchors) == brute(rows, anchors)
    assert len(found) == 8
    for home, _, half, rest in (found[:4], found[4:]):  # the second were too many at once
        pairs = [tuple(r) for df in (home, half, rest) for r in df.collect()]
        assert len(pairs) == len(set(pairs)) < 0.5 * 12 * 60


def test_interval_join_is_complete(spark):
    rng = np.random.default_rng(4)
    keys = [(0, i, int(p), float(lo), float(lo + w)) for i, (p, lo, w) in enumerate(zip(rng.integers(0, 3, 200), rng.uniform(0, 9, 200), rng.uniform(0, 1, 200)))]
    asked = [(0, i, int(p), float(lo), float(lo + w)) for i, (p, lo, w) in enumerate(zip(rng.integers(0, 3, 50), rng.uniform(-3, 12, 50), rng.uniform(0, 4, 50)))]
    k = spark.createDataFrame(keys, "part int, seq int, pivot int, lo double, hi double")
    a = spark.createDataFrame(asked, "q_part int, q_seq int, pivot int, near double, far double")
    for bins in (1, 7):
        got = sorted((r.q_seq, r.seq) for r in negatives.interval_pairs(a, None, k, bins, 10.0).collect())
        assert got == sorted((x[1], y[1]) for x in asked for y in keys if x[2] == y[2] and y[3] <= x[4] and y[4] >= x[3] and x[3] <= 10)


def test_odd_tables(spark):
    assert run(spark, [], [0]) == [] and run(spark, [(0, [1.0], 1)], [0]) == []
    assert run(spark, [(0, [], 1), (1, [], 1), (2, [], 0)], [0]) == [(0, 1, 1, 2, 0, 0)]
    ragged = [(0, [1.0, 2.0], 1), (1, [1.0], 1), (2, [0.5, 0.1, 9.0], 0), (3, [-1.0], 0)]
    assert run(spark, ragged, [0, 1]) == brute(ragged, [0, 1])
    twice = [(0, [1.0], 1), (0, [2.0], 0), (1, [3.0], 1), (2, [2.5], 0)]
    assert run(spark, twice, [0]) in (brute(twice[:1] + twice[2:], [0]), brute(twice[1:], [0]))  # one of the two rows is searched
    with pytest.raises(Exception, match="beyond 64 bits"):
        run(spark, [(0, [1e18], 1), (1, [1.0 / 256], 1)], [0])
    with pytest.raises(Exception, match="beyond 64 bits"):
        run(spark, [(0, [1e10], 1), (1, [1e10], 1)], [0])


def test_wide_values_are_exact(spark):
    rows = [(0, [3.0e6, 1.0], 1), (1, [2.9e6, 7.0], 1), (2, [2.0e6, 3.0], 0), (3, [2.5e6, -1.0], 0)]
    assert run(spark, rows, [0]) == brute(rows, [0])


def test_shares(spark):
    scores = [0, 1, 2, 19, 20, 99, 100, 101, 2**53 + 1, 2**63 - 1]
    df = spark.createDataFrame([(s,) for s in scores], "s long")
    got = df.select(negatives.share_of("s", 50, up=True), negatives.share_of("s", 95, up=False)).collect()
    assert [tuple(r) for r in got] == [(-(-50 * s // 100), 95 * s // 100) for s in scores]


def test_query_against_sql(spark):
    at = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{at}/embeddings.parquet'")
    sql = con.sql(negatives.ORACLE_SQL["op13_hard_negatives"])
    got = negatives.op13_hard_negatives(spark, at).select(sql.columns).collect()
    assert sorted(map(tuple, got)) == sorted(sql.fetchall()) and got
