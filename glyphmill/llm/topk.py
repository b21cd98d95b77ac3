"""Exact top-k search by columnar branch and bound.

Vectors are packed into tiles that lie column by column; candidates are dealt out by falling norm, so a tile's largest norm
bounds all of its scores.  For a tile of queries against a tile of candidates, inner products grow dimension block by dimension
block, dimensions of most mass first.  After each block a candidate's score lies within the product of the masses (norms) that
remain on either side; candidates that can't reach a query's k-th lower bound are left out, and the columns of the others are
compacted.

1. Every query tile is searched against the tile of the largest norms; the k-th scores found are its queries' floors.
2. Tiles whose largest norm can't reach the floor of any query of a tile are never paired with it.  The pairs that are left go
   to tasks by query tile and ``CHUNK`` neighbouring candidate tiles; a task searches them by falling norm and raises the floors
   as it goes, so later tiles are cut short or skipped.
3. Each task emits at most k rows for each query; a window with a group limit merges them.

Components are floor(64 x); products are exact: float64 where they stay below 2**53, 64-bit integers below 2**63, Python's
integers beyond, and a component or a score beyond 64 bits is an error rather than a wrong number.

Vectors that are null, or hold null or non-finite components, take no part; shorter vectors count as filled with zeros.  A
repeated id is a candidate as often as it stands, never for a query of its own id; of repeated query ids the vector of the
smallest hash is searched.  Null ids take no part.  Fewer than k candidates: all are returned; no query or no candidate: no
rows.  Only vec_id and embedding are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import cut, table, whole

#: Rows of a tile of queries and of candidates; dimensions of a block; candidate tiles that a task searches.
QUERY_TILE, CANDIDATE_TILE, BLOCK, CHUNK = 4096, 8192, 16, 4
SCALE = 64


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) -> (vec_id, v array<bigint>) of the vectors that take part."""
    v = vectors.where("vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    return v.select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: whole(x, SCALE)).alias("v"))


TILE = "part int, seq int, ids binary, cols binary, width int, norm double"


def _packer(rows: int):
    """Vectors of a partition -> tiles of at most `rows` vectors, in the order read."""

    def tile(part: int, seq: int, ids: list[int], vectors: list[list[int]]) -> dict:
        out = np.zeros((max(map(len, vectors), default=0), len(ids)), dtype=np.int64)  # a dimension is a row: its column of the tile
        for i, v in enumerate(vectors):
            out[: len(v), i] = v
        kind = np.int16 if not out.size or np.abs(out).max() < 1 << 15 else np.int64
        norm = float(np.sqrt((out.astype(float) ** 2).sum(axis=0)).max(initial=0.0))
        return {"part": part, "seq": seq, "ids": np.array(ids, dtype=np.int64).tobytes(), "cols": out.astype(kind).tobytes(), "width": np.dtype(kind).itemsize, "norm": norm}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        vectors: list[list[int]] = []

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([tile(part, seq, ids, vectors)], schema=PACKED)

        for b in batches:
            for at in range(0, b.num_rows, rows):
                ids += b.column(0).slice(at, rows).to_pylist()
                vectors += b.column(1).slice(at, rows).to_pylist()
                while len(ids) >= rows:
                    rest = ids[rows:], vectors[rows:]
                    del ids[rows:], vectors[rows:]
                    yield full()
                    seq += 1
                    ids, vectors = rest
        if ids:
            yield full()

    return run


PACKED = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("ids", pa.binary()), ("cols", pa.binary()), ("width", pa.int32()), ("norm", pa.float64())])


def _tiles(vectors: DataFrame, rows: int, by_norm: bool) -> tuple[DataFrame, int]:
    """Tiles and the number of parts.  By norm: parts are ranges of falling norm, and equal norms are told apart by a hash, so no part is much above `rows`."""
    n = max(1, -(-vectors.count() // rows))
    salt = F.xxhash64("vec_id", "v")
    if by_norm:
        norm = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
        dealt = vectors.withColumns({"norm": -norm, "salt": salt}).repartitionByRange(n, "norm", "salt").sortWithinPartitions("norm", "salt")
    else:
        dealt = vectors.withColumn("salt", salt).repartition(n, "salt")
    return cut(dealt.select("vec_id", "v").mapInArrow(_packer(rows), TILE)), n


def search(queries: tuple[np.ndarray, np.ndarray], candidates: tuple[np.ndarray, np.ndarray], k: int, block: int = BLOCK, floors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query of two tiles (ids, columns of shape (dims, rows)): (query ids, candidate ids, scores).

    floors: a score of each query that k candidates of other tiles reach already; candidates below it may be left out.
    """
    (q_ids, q), (c_ids, c) = queries, candidates
    dims = max(len(q), len(c), 1)
    q, c = (np.pad(x, ((0, dims - len(x)), (0, 0))) for x in (q, c))
    big = max(1.0, np.abs(q.astype(float)).max(initial=0)) * max(1.0, np.abs(c.astype(float)).max(initial=0)) * max(dims, 1)
    exact = np.float64 if big < 2.0**53 else np.int64 if big < 2.0**62 else object
    order = np.argsort(-(q.astype(float) ** 2).sum(axis=1) * (c.astype(float) ** 2).sum(axis=1), kind="stable")
    q, c = np.ascontiguousarray(q[order].astype(exact)), np.ascontiguousarray(c[order].astype(exact))
    at = list(range(0, dims, block)) + [dims]

    def rest(x: np.ndarray) -> list[np.ndarray]:
        """Norm of what remains after each block."""
        mass = np.add.reduceat(x.astype(float) ** 2, at[:-1], axis=0)
        left = mass.sum(axis=0) - np.cumsum(mass, axis=0)
        return [np.sqrt(np.maximum(r, 0)) for r in left]

    q_rest, c_rest = rest(q), rest(c)
    floors = np.full(len(q_ids), -np.inf) if floors is None else floors
    q_norm, c_norm = (np.sqrt((x.astype(float) ** 2).sum(axis=0)) for x in (q, c))
    reach_all = q_norm * c_norm.max(initial=0.0)
    live = np.flatnonzero(reach_all + 1e-6 * (1 + reach_all) >= floors)
    out_q, out_c, out_s = [], [], []
    for first in range(0, len(live), 128):
        rows = live[first : first + 128]
        scores = q[at[0] : at[1], rows].T @ c[at[0] : at[1]]
        for i, j in enumerate(rows.tolist()):
            s, alive, own_c, own = scores[i], None, c_rest, c_ids == q_ids[j]
            for b in range(len(at) - 1):
                if b:
                    part = c[at[b] : at[b + 1]] if alive is None else c[at[b] : at[b + 1], alive]
                    s = s + q[at[b] : at[b + 1], j] @ part
                if b == len(at) - 2 or len(s) <= 4 * k:
                    continue
                reach = q_rest[b][j] * (own_c[b] if alive is None else own_c[b][alive])
                known = s.astype(float)
                slack = 1e-6 * (1 + np.abs(known).max())
                low = np.where(own if alive is None else own[alive], -np.inf, known - reach)  # rows of the query's own id are no neighbours
                floor = max(np.partition(low, len(low) - k)[len(low) - k], floors[j]) - slack
                keep = np.flatnonzero(known + reach >= floor)
                if len(keep) < 0.7 * len(s):
                    alive = keep if alive is None else alive[keep]
                    s = s[keep]
            ids = c_ids if alive is None else c_ids[alive]
            other = ids != q_ids[j]
            ids, s = ids[other], s[other]
            if exact is object and any(abs(x) >= 1 << 63 for x in s.tolist()):
                raise OverflowError(f"query {q_ids[j]}: a score is beyond 64 bits")
            s = s.astype(np.int64)
            if len(s) > k:
                least = np.partition(s, len(s) - k)[len(s) - k]
                ids, s = ids[s >= least], s[s >= least]
            best = np.lexsort((ids, -s))[:k]
            out_q.append(np.full(len(best), q_ids[j]))
            out_c.append(ids[best])
            out_s.append(s[best])
    if not out_q:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(out_q), np.concatenate(out_c), np.concatenate(out_s)


def _unpacked(ids: bytes, cols: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, dtype=np.int64)
    return own, np.frombuffer(cols, dtype=np.int16 if width == 2 else np.int64).reshape(-1, len(own))


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
FIRST = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("floors", pa.binary()), ("need", pa.float64()), ("query_id", pa.list_(pa.int64())), ("vec_id", pa.list_(pa.int64())), ("score", pa.list_(pa.int64()))])


def floors_of(q_ids: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray], k: int, floors: np.ndarray) -> np.ndarray:
    """The k-th score of each query, where k candidates are found, or the floor it had."""
    place = {int(i): j for j, i in enumerate(q_ids)}
    out, n = floors.copy(), np.zeros(len(q_ids), dtype=np.int64)
    least = np.full(len(q_ids), np.inf)
    at = np.fromiter((place[int(i)] for i in found[0]), dtype=np.int64, count=len(found[0]))
    np.add.at(n, at, 1)
    np.minimum.at(least, at, found[2].astype(float))
    return np.where(n >= k, np.maximum(out, least), out)


def _first_search(k: int):
    """Pairs of a query tile and the leading candidate tile -> what is found, floors, and the least norm that can reach one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                own = _unpacked(r["q_ids"], r["q_cols"], r["q_width"])
                found = search(own, _unpacked(r["ids"], r["cols"], r["width"]), k)
                floors = floors_of(own[0], found, k, np.full(len(own[0]), -np.inf))
                norms = np.sqrt((own[1].astype(float) ** 2).sum(axis=0))
                with np.errstate(divide="ignore", invalid="ignore"):
                    need = np.where(norms > 0, floors / norms, -np.inf)
                need = float(need.min(initial=np.inf))
                row = {"part": r["q_part"], "seq": r["q_seq"], "floors": floors.tobytes(), "need": need - 1e-6 * (1 + abs(need)) if np.isfinite(need) else need}
                yield pa.RecordBatch.from_pylist([{**row, "query_id": found[0], "vec_id": found[1], "score": found[2]}], schema=FIRST)

    return run


def _chunk_search(k: int):
    """A query tile and its candidate tiles of a chunk -> rows found; floors rise from tile to tile."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[pa.Table] = []
        for q in left.to_pylist():
            own, floors = _unpacked(q["ids"], q["cols"], q["width"]), np.frombuffer(q["floors"], dtype=float)
            for c in right.sort_by([("norm", "descending")]).to_pylist():
                found = search(own, _unpacked(c["ids"], c["cols"], c["width"]), k, floors=floors)
                floors = floors_of(own[0], found, k, floors)
                out.append(pa.Table.from_arrays([pa.array(x, pa.int64()) for x in found], schema=FOUND))
        return pa.concat_tables(out) if out else FOUND.empty_table()

    return run


#: Groups of neighbouring parts whose largest norms tell how far a query tile reaches.
STEPS = 1024


def tile_pairs(q: DataFrame, c: DataFrame, parts: int) -> DataFrame:
    """(q_part, q_seq, part, seq) of the pairs of tiles that may hold a neighbour, from their norms alone; q: (part, seq, need).

    Parts lie by falling norm, so what a query tile reaches is a run of parts from the first.  Its end is found among at most STEPS groups of
    parts, and only parts up to there are listed, so the list is longer than the pairs by one group a query tile at most.
    """
    width = -(-parts // STEPS)
    most = c.groupBy(F.floor(F.col("part") / width).alias("step")).agg(F.max("norm").alias("norm")).orderBy("step").collect()
    steps = F.array(*(F.struct(F.lit(r.step).alias("step"), F.lit(r.norm).alias("norm")) for r in most)).cast("array<struct<step:bigint,norm:double>>")
    reached = F.filter(steps, lambda g: g["norm"] >= F.col("need"))
    end = F.least((F.element_at(reached, -1)["step"] + 1) * width, F.lit(parts)) - 1
    asked = q.select(F.col("part").alias("q_part"), F.col("seq").alias("q_seq"), "need", F.when(F.size(reached) > 0, end.cast("int")).alias("end")).where("end is not null")
    asked = asked.select("q_part", "q_seq", "need", F.explode(F.sequence(F.lit(0), F.col("end"))).alias("part"))
    return asked.join(c.select("part", "seq", "norm"), "part").where("norm >= need").select("q_part", "q_seq", "part", "seq")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """quantised queries and candidates -> (query_id, rank, vec_id, score): highest scores first, ties to the smaller id."""
    one = queries.groupBy("vec_id").agg(F.min(F.struct(F.xxhash64("v").alias("h"), "v")).alias("s")).select("vec_id", "s.v")
    q, _ = _tiles(one, QUERY_TILE, by_norm=False)
    c, parts = _tiles(candidates, CANDIDATE_TILE, by_norm=True)
    lead = c.select("part", "seq", "norm").orderBy(F.desc("norm"), "part", "seq").first()
    if lead is None:
        return candidates.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    own = q.select(F.col("part").alias("q_part"), F.col("seq").alias("q_seq"), F.col("ids").alias("q_ids"), F.col("cols").alias("q_cols"), F.col("width").alias("q_width"), (F.col("part") * 0).alias("lead"))
    leader = c.where((F.col("part") == lead.part) & (F.col("seq") == lead.seq)).select((F.col("part") * 0).alias("lead"), "ids", "cols", "width")
    begun = own.join(F.broadcast(leader), "lead").repartition(F.xxhash64("q_part", "q_seq")).mapInArrow(_first_search(k), "part int, seq int, floors binary, need double, query_id array<long>, vec_id array<long>, score array<long>")
    begun = cut(begun)
    others = c.where((F.col("part") != lead.part) | (F.col("seq") != lead.seq))
    chunk = F.floor(F.col("part") / CHUNK).cast("int").alias("chunk")
    pairs = tile_pairs(begun, others, parts)
    left = pairs.select("q_part", "q_seq", chunk).distinct().join(q.join(begun.select("part", "seq", "floors"), ["part", "seq"]).withColumnsRenamed({"part": "q_part", "seq": "q_seq"}), ["q_part", "q_seq"])
    right = pairs.join(others, ["part", "seq"]).select("q_part", "q_seq", chunk, "ids", "cols", "width", "norm")
    keys = ["q_part", "q_seq", "chunk"]
    left = left.select(*(F.col(x).alias(f"l_{x}") for x in keys), "ids", "cols", "width", "floors")  # names of its own: both sides come from `pairs`
    rest = left.groupBy(*(f"l_{x}" for x in keys)).cogroup(right.groupBy(*keys)).applyInArrow(_chunk_search(k), "query_id long, vec_id long, score long")
    first = begun.select(F.explode(F.arrays_zip("query_id", "vec_id", "score")).alias("r")).select("r.*")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return first.unionByName(rest).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return top_k(vectors.where("vec_id % 20 = 0"), vectors)


ORACLE_SQL = {
    "op1_exact_top_k": """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v
           from embeddings where vec_id is not null and embedding is not null
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id,
             cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
      from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as "rank", vec_id, score from s)
select query_id, "rank", vec_id, score from r where "rank" <= 20
"""
}
