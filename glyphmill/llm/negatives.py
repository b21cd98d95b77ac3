"""Hard negatives by one-dimensional distance keys.

Inner products become distances: a row x with a last coordinate sqrt(M^2 - |x|^2), where M is the largest norm, lies at the squared
distance |q|^2 + M^2 - 2 <q, x> of an anchor q with a last coordinate 0.  Rows belong to their nearest pivot; the index stores them
sorted by (pivot, distance to it), packed into tiles that hold one interval of keys each.  By the triangle inequality a row within r
of q has a key within r of q's own distance to that pivot: a search of radius r scans one interval of keys a pivot, an annulus.

1. Anchors are packed into tiles too.  A round scans, for each tile of anchors, the intervals of keys that no earlier round scanned;
   keys and intervals meet in a range join by bins of distance.
2. First come the keys where anchors lie themselves, then annuli of the radius that is still open; where those would be more than
   ``AT_ONCE`` index tiles an anchor tile, annuli of half of it come between, which narrow it.  The open radius of an anchor is the
   distance of its k-th score so far (or of the least score that counts, or what any row can be at); after the last round no row outside
   of what was scanned can be nearer, which certifies the result.
3. Positives are the k best rows of the anchor's label; each positive then asks for the best rows of other labels whose scores stay
   within its bounds.  Both are the same search.

Scores are integer inner products of floor(scale x): exact in float64 below 2**53, in 64-bit integers beyond, in Python's integers
beyond those; a component or a score beyond 64 bits is an error.  Bounds of distances have slack for rounding.

Null ids, null labels, null vectors and vectors with null or non-finite components take no part; shorter vectors count as filled with
zeros.  Rows repeated whole count once; rows of one id but other vectors or labels are rows of their own, never neighbours of an
anchor of that id, and of an anchor's repeated id the row of the smallest hash is searched.  Of rows with one vector and label those
of the smallest ids are kept, one more than can be returned, so copies neither fill tiles nor change results.  Ties go to the smaller
id.  Too few rows: what there is.  An empty table gives no rows.  Only vec_id, embedding and label are read, so other columns may have
any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import cut, small_batches, table, whole, written

#: Rows of a tile of anchors and of the index; index tiles that a task scans; pivots and the sampled rows they are fitted on, at most; index tiles
#: an anchor tile beyond which a round of half the radius pays.
ANCHOR_TILE, TILE, CHUNK, PIVOTS, SAMPLE, AT_ONCE = 1024, 4096, 4, 64, 4096, 256
SCALE = 256
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, embedding, label) -> (vec_id, label, v array<bigint>) of the rows that take part."""
    v = vectors.where("vec_id is not null and label is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    return v.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.transform("embedding", lambda x: whole(x, scale)).alias("v"))


def distinct_rows(rows: DataFrame, most: int) -> DataFrame:
    """Rows repeated whole once, and of each vector and label the `most` smallest ids; both are combined before they are shuffled."""
    once = rows.withColumn("h", F.xxhash64("v")).dropDuplicates(["h", "label", "v", "vec_id"])
    rank = F.row_number().over(Window.partitionBy("h", "label", "v").orderBy("vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= most).select("vec_id", "label", "v")


def columns_of(lists: pa.Array, dims: int) -> np.ndarray:
    """Vectors of a batch as rows of an array, filled with zeros."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), dims), dtype=np.int64)
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def lifted(v: np.ndarray, norm: float | None) -> np.ndarray:
    """Rows with their last coordinate: what is left of the norm, or 0 for anchors (norm None)."""
    x = v.astype(float)
    last = np.zeros(len(x)) if norm is None else np.sqrt(np.maximum(norm * norm - (x * x).sum(axis=1), 0))
    return np.concatenate((x, last[:, None]), axis=1)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distance of each row to each pivot."""
    return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def fitted(sample: np.ndarray, n: int, rounds: int = 6) -> np.ndarray:
    """Pivots: centres that start far apart and are moved to the means of their rows."""
    chosen = [sample[0]]
    gap = ((sample - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < n and gap.max() > 0:
        chosen.append(sample[int(gap.argmax())])
        gap = np.minimum(gap, ((sample - chosen[-1]) ** 2).sum(axis=1))
    pivots = np.array(chosen)
    for _ in range(rounds):
        own = distances(sample, pivots).argmin(axis=1)
        pivots = np.array([sample[own == i].mean(axis=0) if (own == i).any() else p for i, p in enumerate(pivots)])
    return pivots


def packed(cols: np.ndarray) -> dict:
    """Columns (dims, rows) as bytes, two each where they fit."""
    kind = np.int16 if not cols.size or np.abs(cols).max() < 1 << 15 else np.int64
    return {"cols": np.ascontiguousarray(cols.astype(kind)).tobytes(), "width": np.dtype(kind).itemsize}


def unpacked(cols: bytes, width: int, rows: int) -> np.ndarray:
    return np.frombuffer(cols, dtype=np.int16 if width == 2 else np.int64).reshape(-1, rows)


def _keyed(dims: int, norm: float | None, pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = distances(lifted(columns_of(b.column(2), dims), norm), pivots)
            own = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.astype(np.int32)), pa.array(d[np.arange(len(own)), own])], names=["vec_id", "label", "v", "pivot", "key"])

    return run


TILES = "part int, seq int, pivot int, lo double, hi double, ids array<long>, labels array<long>, cols binary, width int"
PACKED = pa.schema(
    [("part", pa.int32()), ("seq", pa.int32()), ("pivot", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("cols", pa.binary()), ("width", pa.int32())]
)


def _packer(rows: int, dims: int, one_pivot: bool):
    """Sorted rows of a partition -> tiles of at most `rows` of them; of one pivot each, if asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def tile(n: int) -> pa.RecordBatch:
            nonlocal held, size
            ids, labels, v, pivot, key = (np.concatenate(c) for c in zip(*held))
            held, size = [tuple(c[n:] for c in (ids, labels, v, pivot, key))], size - n
            row = {"part": part, "seq": seq, "pivot": int(pivot[0]), "lo": float(key[:n].min()), "hi": float(key[:n].max()), "ids": ids[:n], "labels": labels[:n], **packed(v[:n].T)}
            return pa.RecordBatch.from_pylist([row], schema=PACKED)

        def ready(last: bool) -> int:
            """Rows of the next tile, 0 if it may still grow."""
            if not size:
                return 0
            if one_pivot:
                pivot = np.concatenate([h[3] for h in held])
                change = np.flatnonzero(pivot != pivot[0])
                if len(change):
                    return min(rows, int(change[0]))
            return min(rows, size) if size >= rows or last else 0

        for b in batches:
            if b.num_rows:
                held.append((b.column(0).to_numpy(), b.column(1).to_numpy(), columns_of(b.column(2), dims), b.column(3).to_numpy(), b.column(4).to_numpy()))
                size += b.num_rows
            while n := ready(last=False):
                yield tile(n)
                seq += 1
        while n := ready(last=True):
            yield tile(n)
            seq += 1

    return run


def tiles(rows: DataFrame, count: int, size: int, dims: int, norm: float | None, pivots: np.ndarray, one_pivot: bool) -> DataFrame:
    """(vec_id, label, v) -> tiles in the order of their keys; equal keys are told apart by a hash, so none fills a task."""
    keyed = rows.mapInArrow(_keyed(dims, norm, pivots), "vec_id long, label long, v array<long>, pivot int, key double").withColumn("salt", F.xxhash64("vec_id", "label", "v"))
    dealt = keyed.repartitionByRange(max(1, -(-count // size)), "pivot", "key", "salt").sortWithinPartitions("pivot", "key", "salt")
    return written(dealt.drop("salt").mapInArrow(_packer(size, dims, one_pivot), TILES), "tiles")


def product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of the columns of q and c."""
    big = max(1.0, np.abs(q.astype(float)).max(initial=0)) * max(1.0, np.abs(c.astype(float)).max(initial=0)) * max(len(q), 1)
    kind = np.float64 if big < 2.0**53 else np.int64 if big < 2.0**62 else object
    s = q.astype(kind).T @ c.astype(kind)
    if kind is object and any(abs(x) >= 1 << 63 for x in s.ravel().tolist()):
        raise OverflowError("a score is beyond 64 bits")
    return s.astype(np.int64)


def radius(norm2: np.ndarray, lo: np.ndarray, norm: float) -> np.ndarray:
    """Distance of a row that scores lo, or what any row can be at, whichever is less."""
    any_row = np.sqrt(norm2) + norm
    return np.minimum(np.sqrt(np.maximum(norm2 + norm * norm - 2 * lo.astype(float), 0)), any_row)


def open_radii(ids: np.ndarray, needs: list[dict], norm2: np.ndarray, norm: float) -> np.ndarray:
    """For each anchor of a tile the widest of its needs, with slack; -1 without any."""
    place = {int(x): i for i, x in enumerate(ids)}
    out = np.full(len(ids), -1.0)
    if needs:
        at = np.array([place[n["query_id"]] for n in needs])
        r = radius(norm2[at], np.array([n["lo"] for n in needs], dtype=np.int64), norm)
        np.maximum.at(out, at, r + 1e-6 * (1 + norm + np.sqrt(norm2[at])))
    return out


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller id."""
    if len(scores) > k:
        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[keep], scores[keep]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


FOUND = pa.schema([("query_id", pa.int64()), ("slot", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])
ANNULI = pa.schema([("q_part", pa.int32()), ("q_seq", pa.int32()), ("pivot", pa.int32()), ("near", pa.float64()), ("far", pa.float64())])


def _annuli(pivots: np.ndarray, norm: float, share: float | None):
    """A tile of anchors and its needs -> for each pivot the interval of keys within a share of the open radius; without a share, of the keys of the anchors themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                v = unpacked(r["cols"], r["width"], len(r["ids"])).T
                wide = open_radii(np.array(r["ids"]), r["needs"], (v.astype(float) ** 2).sum(axis=1), norm)
                d = distances(lifted(v, None), pivots)
                asks = np.repeat((wide >= 0)[:, None], len(pivots), axis=1)
                if share is None:
                    asks &= d.argmin(axis=1)[:, None] == np.arange(len(pivots))
                reach = np.zeros(len(d)) if share is None else np.maximum(wide, 0) * share
                begin, end = np.where(asks, d - reach[:, None], np.inf).min(axis=0), np.where(asks, d + reach[:, None], -np.inf).max(axis=0)
                rows = [(r["q_part"], r["q_seq"], i, begin[i], end[i]) for i in np.flatnonzero(asks.any(axis=0)).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows), ANNULI)], schema=ANNULI) if rows else pa.RecordBatch.from_pylist([], schema=ANNULI)

    return run


def _scan(pivots: np.ndarray, norm: float, k: int, same: bool):
    """A tile of anchors, its needs and some index tiles -> the k best rows found for each need; floors rise from tile to tile."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        index = right.to_pylist()
        for t in left.to_pylist():
            ids, labels = np.array(t["ids"], dtype=np.int64), np.array(t["labels"], dtype=np.int64)
            q = unpacked(t["cols"], t["width"], len(ids))
            norm2 = (q.astype(float) ** 2).sum(axis=0)
            d = distances(lifted(q.T, None), pivots)
            needs: dict[int, list[dict]] = {}
            for n in t["needs"]:
                needs.setdefault(n["query_id"], []).append(n)

            def gap(c: dict) -> np.ndarray:
                """The least distance that a row of an index tile can have, for each anchor."""
                return np.maximum(np.maximum(d[:, c["pivot"]] - c["hi"], c["lo"] - d[:, c["pivot"]]), 0)

            for c in sorted(index, key=lambda c: gap(c).min()):
                wide = open_radii(ids, [n for own in needs.values() for n in own], norm2, norm)
                live = np.flatnonzero((wide >= 0) & (gap(c) <= wide))
                if not len(live):
                    continue
                c_ids, c_labels = np.array(c["ids"], dtype=np.int64), np.array(c["labels"], dtype=np.int64)
                own = unpacked(c["cols"], c["width"], len(c_ids))
                for first in range(0, len(live), 128):
                    rows = live[first : first + 128]
                    for i, s in zip(rows.tolist(), product(q[:, rows], own)):
                        fits = ((c_labels == labels[i]) == same) & (c_ids != ids[i])
                        for n in needs[int(ids[i])]:
                            at = np.flatnonzero(fits & (s >= n["lo"]) & (s <= n["hi"]))
                            if len(at):
                                met = n.get("met", (c_ids[:0], s[:0]))
                                n["met"] = best(np.append(met[0], c_ids[at]), np.append(met[1], s[at]), k)
                                if len(n["met"][0]) == k:
                                    n["lo"] = int(n["met"][1][-1])
            out += [(np.full(len(n["met"][0]), n["query_id"]), np.full(len(n["met"][0]), n["slot"]), *n["met"]) for own in needs.values() for n in own if "met" in n]
        if not out:
            return FOUND.empty_table()
        return pa.Table.from_arrays([pa.array(np.concatenate(c), type=f.type) for c, f in zip(zip(*out), FOUND)], schema=FOUND)

    return run


def interval_pairs(annuli: DataFrame, seen: DataFrame | None, keys: DataFrame, bins: int, top: float) -> DataFrame:
    """(q_part, q_seq, part, seq) of tiles whose keys meet an annulus and met none before.

    A range join: both sides stand in every bin of distance that they touch, and a pair counts in the first bin they share.
    """
    width = top / bins or 1.0

    def binned(df: DataFrame, begin: str, end: str) -> DataFrame:
        first, last = (F.floor(F.least(F.greatest(F.col(x), F.lit(0.0)), F.lit(top)) / width).cast("int") for x in (begin, end))
        return df.withColumn("first", first).withColumn("bin", F.explode(F.sequence("first", last)))

    asked = binned(annuli.where(F.col("near") <= top), "near", "far").withColumnRenamed("first", "first_asked")
    both = asked.join(binned(keys, "lo", "hi"), ["pivot", "bin"]).where("lo <= far and hi >= near and bin = greatest(first, first_asked)")
    if seen is not None:
        before = seen.select("q_part", "q_seq", "pivot", F.col("near").alias("was_near"), F.col("far").alias("was_far"))
        both = both.join(before, ["q_part", "q_seq", "pivot"], "left").where("was_near is null or lo > was_far or hi < was_near")
    return both.select("q_part", "q_seq", "part", "seq")


def merged(parts: DataFrame, size: int) -> DataFrame:
    """Tiles in the order of their keys -> (q_part, q_seq, ids, labels, cols, width), neighbours joined to tiles of `size` to 2 `size` rows, however many partitions made them.

    The running sum is over tiles, not rows.
    """
    before = F.coalesce(F.sum(F.size("ids")).over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = parts.select("part", "seq", "ids").withColumn("q_part", F.floor(before / size).cast("int")).select("part", "seq", "q_part")

    def run(t: pa.Table) -> pa.Table:
        rows = t.sort_by([("part", "ascending"), ("seq", "ascending")]).to_pylist()
        cols = np.concatenate([unpacked(r["cols"], r["width"], len(r["ids"])) for r in rows], axis=1)
        row = {"q_part": rows[0]["q_part"], "q_seq": 0, "ids": [x for r in rows for x in r["ids"]], "labels": [x for r in rows for x in r["labels"]], **packed(cols)}
        return pa.Table.from_pylist([row], schema=ANCHORS)

    return written(parts.join(place, ["part", "seq"]).groupBy("q_part").applyInArrow(run, "q_part int, q_seq int, ids array<long>, labels array<long>, cols binary, width int"), "anchors")


ANCHORS = pa.schema([("q_part", pa.int32()), ("q_seq", pa.int32()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("cols", pa.binary()), ("width", pa.int32())])


class Index:
    """Tiles of keys over (vec_id, label, v); `copies` is how many ids of one vector and label can matter."""

    def __init__(self, rows: DataFrame, copies: int):
        self.rows = written(distinct_rows(rows, copies), "vectors")
        norm2 = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
        n, dims, top = self.rows.agg(F.count("*"), F.max(F.size("v")), F.max(norm2)).first()
        self.count, self.dims, self.norm = n, dims or 0, float(np.sqrt(top or 0.0))
        if not n:
            return
        sample = self.rows.orderBy(F.xxhash64("vec_id", "label", "v")).limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
        self.pivots = fitted(lifted(columns_of(sample, self.dims), self.norm), max(1, min(PIVOTS, n // TILE)))
        self.tiles = tiles(self.rows, n, TILE, self.dims, self.norm, self.pivots, one_pivot=True)
        self.keys = self.tiles.select("part", "seq", "pivot", "lo", "hi")
        self.top, count = self.keys.agg(F.max("hi"), F.count("*")).first()
        self.bins = max(1, count // len(self.pivots))

    def anchors(self, rows: DataFrame) -> DataFrame:
        """Tiles of anchors (vec_id, label, v), one row an id."""
        one = rows.groupBy("vec_id").agg(F.min(F.struct(F.xxhash64("label", "v").alias("h"), "label", "v")).alias("s")).select("vec_id", "s.label", "s.v")
        one = written(one, "anchors")
        n, dims = one.agg(F.count("*"), F.max(F.size("v"))).first()
        if (dims or 0) > self.dims:
            raise ValueError(f"an anchor has {dims} dimensions, the index {self.dims}")
        return merged(tiles(one, n, ANCHOR_TILE, self.dims, None, self.pivots, one_pivot=False), ANCHOR_TILE)

    def search(self, anchors: DataFrame, needs: DataFrame, k: int, same: bool) -> DataFrame:
        """needs (query_id, slot, lo, hi) -> (query_id, slot, vec_id, score, rank): the k best rows of the anchor's label, or of others, that score from lo to hi."""
        place = anchors.select("q_part", "q_seq", F.explode("ids").alias("query_id"))
        rank = F.row_number().over(Window.partitionBy("query_id", "slot").orderBy(F.col("score").desc(), "vec_id"))
        found, seen, share, halved = None, None, None, False
        while True:
            own = needs
            if found is not None:
                floors = found.groupBy("query_id", "slot").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
                own = needs.join(floors, ["query_id", "slot"], "left").withColumn("lo", F.greatest("lo", "floor")).drop("floor")
            asked = own.join(place, "query_id").groupBy("q_part", "q_seq").agg(F.collect_list(F.struct("query_id", "slot", "lo", "hi")).alias("needs"))
            asked = cut(anchors.join(asked, ["q_part", "q_seq"]))
            annuli, pairs = self._pairs(asked, seen, share)
            if share == 1.0 and not halved and pairs.count() > AT_ONCE * asked.count():
                share, halved = 0.5, True
                annuli, pairs = self._pairs(asked, seen, share)
            keys = ["q_part", "q_seq", "chunk"]
            left = pairs.select(*keys).distinct().join(asked, ["q_part", "q_seq"])
            left = left.select(*(F.col(x).alias(f"l_{x}") for x in keys), "ids", "labels", "cols", "width", "needs")  # names of its own: both sides come from `pairs`
            right = pairs.join(self.tiles, ["part", "seq"]).select(*keys, "pivot", "lo", "hi", "ids", "labels", "cols", "width")
            new = left.groupBy(*(f"l_{x}" for x in keys)).cogroup(right.groupBy(*keys)).applyInArrow(_scan(self.pivots, self.norm, k, same), "query_id long, slot int, vec_id long, score long")
            new = new if found is None else found.drop("rank").unionByName(new)
            found = cut(new.withColumn("rank", rank).where(F.col("rank") <= k))
            if share == 1.0:
                return found
            # what was scanned before lies about the same middle, so both intervals are one
            seen = annuli if seen is None else cut(seen.unionByName(annuli).groupBy("q_part", "q_seq", "pivot").agg(F.min("near").alias("near"), F.max("far").alias("far")))
            share = 1.0

    def _pairs(self, asked: DataFrame, seen: DataFrame | None, share: float | None) -> tuple[DataFrame, DataFrame]:
        """The annuli of a round, and the pairs of tiles that it scans, by chunks of the index."""
        annuli = cut(asked.mapInArrow(_annuli(self.pivots, self.norm, share), "q_part int, q_seq int, pivot int, near double, far double"))
        return annuli, cut(interval_pairs(annuli, seen, self.keys, self.bins, self.top).withColumn("chunk", F.floor(F.col("part") / CHUNK).cast("int")))


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def share_of(score: str, percent: int, up: bool):
    """percent of a column that is not negative, rounded up or down, without overflow."""
    return F.expr(f"{score} div 100 * {percent} + ({score} % 100 * {percent} + {99 if up else 0}) div 100")


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """rows and anchors (vec_id, label, v) -> RESULT: for each anchor and each of its best rows of the same label the best rows of other labels
    with low * positive_score <= 100 * negative_score <= high * positive_score."""
    if not 0 <= low < high <= 100:
        raise ValueError("bounds must be percentages, the lower first")
    small_batches(rows.sparkSession)
    index = Index(rows, max(positives, negatives) + 1)
    if not index.count:
        return rows.sparkSession.createDataFrame([], RESULT)
    own = index.anchors(anchors)
    ids = own.select(F.explode("ids").alias("query_id"))
    first = index.search(own, ids.select("query_id", F.lit(0).alias("slot"), F.lit(LEAST).alias("lo"), F.lit(MOST).alias("hi")), positives, same=True)
    best_rows = first.select(F.col("query_id").alias("anchor_id"), F.col("vec_id").alias("positive_id"), F.col("rank").alias("slot"), F.col("score").alias("positive_score"))
    bounds = share_of("positive_score", low, up=True).alias("lo"), share_of("positive_score", high, up=False).alias("hi")
    needs = best_rows.where("positive_score >= 0").select(F.col("anchor_id").alias("query_id"), "slot", *bounds)
    second = index.search(own, needs, negatives, same=False)
    second = second.select(F.col("query_id").alias("anchor_id"), "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return best_rows.join(second, ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    rows = quantised(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))
    return hard_negatives(rows, rows.where("vec_id % 50 = 0"))


ORACLE_SQL = {
    "op13_hard_negatives": """
with v as (select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                  list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
           from embeddings where vec_id is not null and label is not null and embedding is not null
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as anchor_id, c.vec_id, q.label = c.label as same,
             cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
      from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
p as (select anchor_id, vec_id as positive_id, score as positive_score, row_number() over (partition by anchor_id order by score desc, vec_id) as n
      from s where same),
r as (select p.anchor_id, positive_id, positive_score, s.vec_id as negative_id, s.score as negative_score,
             cast(row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id) as int) as "rank"
      from p join s on s.anchor_id = p.anchor_id
      where n <= 5 and not same and 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score)
select anchor_id, positive_id, "rank", negative_id, positive_score, negative_score from r where "rank" <= 3
"""
}
