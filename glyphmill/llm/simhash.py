"""SimHash near-duplicates by generalised pigeonhole.

``fingerprints`` makes 64-bit majority fingerprints of 4-word shingles.  ``near_components`` links all fingerprints
that differ in at most ``tau`` bits and returns connected components:

1. Equal fingerprints become one node, so copies cost nothing further.
2. ``plan`` groups correlated bits into m partitions and allots each a threshold, together tau - m + 1, by dynamic
   programming on the estimated number of signatures and candidates, for every m; two fingerprints within tau bits agree
   within the threshold in one partition at least.  The estimates come from bit counts over all fingerprints.
3. Each bucket (partition, value) first links its members with its pivots: one link a member, never a pair of members.
   Components of these links take up groups of near copies.
4. Buckets that still hold two components or more are probed: rows of different components are verified on their whole
   fingerprints in numpy, and only links that join components leave the task.  A bucket above ``block`` rows is dealt
   out as pairs of blocks; a pair whose rows are all of one component is left out.

Null or wordless texts have fingerprint zero, linked like any other.  Repeated rows are rows of one fingerprint; rows of one
doc_id and different texts are linked by their fingerprints alone.  An empty table gives no rows.  Rows whose doc_id is null
link like others; the component_id of a component of such rows alone is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.common import cut, small_batches, table, texts_of
from glyphmill.llm.graph import components

BITS = 64


def fingerprint(text: bytes, width: int = 4) -> int:
    """Bit b is set if it is set in over half of the shingles' XXH64 (seed 42); repeats count."""
    words = text.lower().split()  # bytes: A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, 42)
    lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lens + 1) - 1
    digest = xxhash.xxh64_intdigest
    spans = zip((ends - lens)[: 1 - width].tolist(), ends[width - 1 :].tolist())
    hashes = np.fromiter([digest(joined[s:e], 42) for s, e in spans], dtype="<u8", count=len(words) - width + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.fromiter(map(fingerprint, texts_of(b.column(1))), dtype=np.uint64, count=b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=[b.schema.names[0], "fp"])


def fingerprints(docs: DataFrame, of: str = "doc_id") -> DataFrame:
    """docs (of, text) -> (of, fp long); the column `of` comes back as it is."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(of).cast("long").alias(of) if of == "doc_id" else F.col(of), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprint_batches, f"{of} {rows.schema[of].dataType.simpleString()}, fp long")


# --- the plan


def _bit_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros((BITS, BITS)), 0
    for b in batches:
        x = _bits(b.column(0).to_numpy(zero_copy_only=False)).astype(np.float32)
        total, n = total + x.T @ x, n + len(x)
    flat = np.append(total.ravel(), n).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["cell", "n"])


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_statistics(nodes: DataFrame) -> tuple[np.ndarray, int]:
    """How often bits i and j are both set, over all fingerprints; 4,097 sums reach the driver, at any size."""
    rows = nodes.select("fp").mapInArrow(_bit_products, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1, dtype=np.int64)
    for r in rows:
        flat[r.cell] = r.n
    return flat[:-1].reshape(BITS, BITS), int(flat[-1])


def group_bits(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m partitions of nearly equal width; each begins with the free bit of most correlation and takes its closest."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    free, out = list(range(BITS)), []
    for k in range(m):
        width = BITS // m + (k < BITS % m)
        group = [max(free, key=lambda b: (corr[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < width:
            b = max(free, key=lambda b: (corr[b, group].sum(), -b))
            group.append(b)
            free.remove(b)
        out.append(sorted(group))
    return out


def _within(agree: np.ndarray, most: int) -> list[float]:
    """Chance that at most 0, 1, ... most of the bits differ, given each bit's chance to agree."""
    dist = np.zeros(most + 1)
    dist[0] = 1
    for a in agree:
        dist = dist * a + np.append(0, dist[:-1]) * (1 - a)
    return np.cumsum(dist).tolist()


#: Cost of one signature row that is shuffled and sorted, against one candidate that is verified.
SIGNATURE_COST = 60.0


def allot(groups: list[list[int]], agree: np.ndarray, n: int, tau: int) -> tuple[float, list[int]]:
    """Thresholds (-1: the partition is not probed) that sum to tau - m + 1 at the least estimated cost."""
    m = len(groups)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for g in groups:
        near = _within(agree[g], tau)
        then: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, picked) in best.items():
            for t in range(-1, tau + 1):
                own = 0.0 if t < 0 else n * SIGNATURE_COST * (1 + (t > 0) * sum(comb(len(g), k) for k in range(1, t + 1))) + near[t] * n * n / 2
                if used + t not in then or cost + own < then[used + t][0]:
                    then[used + t] = (cost + own, [*picked, t])
        best = then
    return best[tau - m + 1]


def plan(both: np.ndarray, n: int, tau: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that is probed, over the m of least cost."""
    p = np.diag(both) / max(n, 1)
    agree = p * p + (1 - p) * (1 - p)
    options = []
    for m in range(1, tau + 2):
        groups = group_bits(both, n, m)
        cost, picked = allot(groups, agree, n, tau)
        options.append((cost, m, [(g, t) for g, t in zip(groups, picked) if t >= 0]))
    return min(options, key=lambda o: o[:2])[2]


# --- buckets


def _value(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), dtype=np.uint64)
    for k, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def _signatures(parts: list[tuple[list[int], int]], probes: bool):
    """(fp, node, comp, n) -> a row for each partition's own value and, with probes, each value within its threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i, (bits, t) in enumerate(parts):
                own = _value(fps, bits)
                masks = [0, *(sum(1 << k for k in c) for d in range(1, t + 1) for c in combinations(range(len(bits)), d))] if probes else [0]
                for mask in masks:
                    keys = (own ^ np.uint64(mask)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), i, dtype=np.int32)), pa.array(keys), *b.columns, pa.array(np.full(len(fps), not mask))], names=["part", "key", *b.schema.names, "own"])

    return run


def _verify(tau: int):
    """Rows sorted by (part, key, cell) -> links between components of pairs within tau bits, one of them its bucket's own."""

    def links(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        part, key, cell, fp, comp, own, side = cols
        new = np.flatnonzero((np.diff(part) != 0) | (np.diff(key) != 0) | (np.diff(cell) != 0)) + 1
        sizes = np.diff(np.concatenate(([0], new, [len(part)])))
        end = np.repeat(np.concatenate((new, [len(part)])), sizes)
        at, lag = np.arange(len(part)), 1
        found: list[np.ndarray] = []
        while len(at := at[at + lag < end[at]]):
            to = at + lag
            ok = (comp[at] != comp[to]) & (own[at] | own[to]) & ((side[at] < 0) | (side[at] != side[to]))
            x, y = at[ok], to[ok]
            hit = np.bitwise_count(fp[x] ^ fp[y]) <= tau
            if hit.any():
                a, b = comp[x[hit]], comp[y[hit]]
                found.append(np.unique(np.stack((np.maximum(a, b), np.minimum(a, b)), axis=1), axis=0))
                if len(found) > 64:
                    found = [np.unique(np.concatenate(found), axis=0)]
            lag += 1
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), dtype=np.int64)
        return _spanning(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        names = ["part", "key", "cell", "fp", "comp", "own", "side"]

        def emit(cols: list[np.ndarray]) -> pa.RecordBatch:
            a, b = links(cols)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for b in batches:
            cols = [b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names]
            cols[3] = cols[3].view(np.uint64)
            held.append(cols)
            rows += b.num_rows
            if rows >= 1 << 17:
                cols = [np.concatenate(x) for x in zip(*held)]
                change = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0))
                stop = int(change[-1]) + 1 if len(change) else 0
                if stop:
                    yield emit([c[:stop] for c in cols])
                held, rows = [[c[stop:] for c in cols]], len(cols[0]) - stop
        if rows:
            yield emit([np.concatenate(x) for x in zip(*held)])

    return run


def _spanning(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    kept = []
    for a, b in pairs.tolist():
        ra, rb = root(a), root(b)
        if ra != rb:
            up[max(ra, rb)] = min(ra, rb)
            kept.append((a, b))
    out = np.array(kept, dtype=np.int64).reshape(-1, 2)
    return out[:, 0].copy(), out[:, 1].copy()


def _pivot_links(nodes: DataFrame, parts: list[tuple[list[int], int]], tau: int) -> DataFrame:
    """Links of every member of a bucket with its pivots: the fingerprint of most documents, and the least by two orders."""
    own = nodes.select("fp", "n").mapInArrow(_signatures(parts, False), "part int, key long, fp long, n long, own boolean")
    pivots = own.groupBy("part", "key").agg(
        F.count("*").alias("size"),
        F.max(F.struct("n", "fp")).alias("p0"), F.min(F.struct(F.xxhash64("fp").alias("h"), "fp")).alias("p1"), F.min(F.struct("fp")).alias("p2"),
    ).where("size > 1")
    near = [F.when(F.bit_count(F.col("fp").bitwiseXOR(F.col(f"{p}.fp"))) <= tau, F.col(f"{p}.fp")) for p in ("p0", "p1", "p2")]
    return own.join(pivots, ["part", "key"]).select(F.col("fp").alias("a"), F.explode(F.array_distinct(F.array(*near))).alias("b")).where("a <> b").distinct()


def near_components(fps: DataFrame, tau: int = 4, block: int = 1024) -> DataFrame:
    """fps (doc_id, fp) -> (fp, component, component_id) of each distinct fingerprint; component: the least fingerprint reachable."""
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    both, n = bit_statistics(nodes)
    parts = plan(both, n, tau)
    first = components(_pivot_links(nodes, parts, tau)).withColumnRenamed("node", "fp")
    held = cut(nodes.join(first, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("comp")))

    # the buckets that still hold two components; their signatures are made again rather than kept for all buckets
    signs = held.select("fp", "comp").mapInArrow(_signatures(parts, True), "part int, key long, fp long, comp long, own boolean")
    sizes = signs.groupBy("part", "key").agg(F.count("*").alias("size"), F.max("own").alias("any_own"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("any_own and c0 < c1")
    signs = cut(signs.join(sizes.select("part", "key", "size"), ["part", "key"]))
    columns = ["part", "key", "cell", "fp", "comp", "own", "side"]
    calm = signs.where(F.col("size") <= 2 * block).withColumns({"cell": F.lit(0), "side": F.lit(-1)}).select(columns)
    hot = _cells(signs.where(F.col("size") > 2 * block), block).select(columns)
    found = calm.unionByName(hot).repartition("part", "key", "cell").sortWithinPartitions("part", "key", "cell").mapInArrow(_verify(tau), "a long, b long")
    second = components(found)
    settled = cut(held.join(second.withColumnRenamed("node", "comp"), "comp", "left").select("fp", "least", F.coalesce("component", "comp").alias("component")))
    return settled.join(settled.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fp", "component", "component_id")


def _cells(rows: DataFrame, block: int) -> DataFrame:
    """Large buckets as pairs of blocks.  A component above block rows has blocks of its own; the others share blocks."""
    counts = rows.groupBy("part", "key", "comp").agg(F.count("*").alias("c"))
    counts = counts.join(counts.where(F.col("c") < block).groupBy("part", "key").agg(F.sum("c").alias("small")), ["part", "key"], "left")
    big = F.col("c") >= block
    spread = F.when(big, F.ceil(F.col("c") / block)).otherwise(F.ceil(F.col("small") / block))
    dealt = rows.join(counts.select("part", "key", "comp", big.alias("big"), spread.alias("spread")), ["part", "key", "comp"])
    salt = F.when(F.col("big"), F.pmod(F.xxhash64("fp"), "spread")).otherwise(F.pmod(F.xxhash64("comp"), "spread"))
    dealt = cut(dealt.withColumn("b", F.struct(F.when(F.col("big"), F.col("comp")).alias("of"), salt.alias("s"))))
    blocks = dealt.select("part", "key", "b").distinct()
    x, y = blocks.withColumnRenamed("b", "b0"), blocks.withColumnRenamed("b", "b1")
    pairs = x.join(y, ["part", "key"]).where("(b0 < b1 and not (b0.of <=> b1.of and b0.of is not null)) or (b0 = b1 and b0.of is null)")
    pairs = pairs.withColumn("cell", F.xxhash64("b0", "b1"))
    one = F.array(F.struct(F.col("b0").alias("b"), F.when(F.expr("b0 = b1"), -1).otherwise(0).alias("side")))
    two = F.array(F.struct(F.col("b1").alias("b"), F.lit(1).alias("side")))
    ends = pairs.select("part", "key", "cell", F.explode(F.when(F.expr("b0 = b1"), one).otherwise(F.concat(one, two))).alias("e")).select("part", "key", "cell", "e.b", "e.side")
    return dealt.join(ends, ["part", "key", "b"])


def near_duplicates(docs: DataFrame, tau: int = 4) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, fingerprint of 16 hex digits, component_id), a row for each row."""
    fps = cut(fingerprints(docs))
    groups = near_components(fps, tau)
    return fps.join(groups, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, tau: int = 4) -> DataFrame:
    """One row of each component, with all columns, whatever their names: the row of the smallest doc_id (null last), then of the smallest
    hash of its text, then of the smallest hash of all columns.  Equal rows count once.  No column may be a map."""
    row = F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))
    parts = {"_unnamed": F.col("doc_id").isNull(), "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_a": F.xxhash64("text"), "_b": F.xxhash64(F.lit(1), F.col("text")), "_all": row}
    key = F.struct(*(c.alias(name) for name, c in parts.items()))
    fps = cut(fingerprints(docs.select(key.alias("key"), "text"), "key").select("key", F.when(~F.col("key._unnamed"), F.col("key._id")).alias("doc_id"), "fp"))
    groups = fps.groupBy("fp").agg(F.min("key").alias("key")).join(near_components(fps, tau).select("fp", "component"), "fp")
    kept = groups.groupBy("component").agg(F.min("key").alias("key")).select("key.*")
    own = docs.select(*(c.alias(name) for name, c in parts.items()), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    return own.dropDuplicates(list(parts)).join(kept, list(parts), "left_semi").select("_row.*")  # both by key: rows are shuffled once, equal ones combined before


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
