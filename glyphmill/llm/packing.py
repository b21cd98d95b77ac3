"""Best-fit packing of token sequences, in bulk.

Documents become token ids and, where they are longer than a sequence, pieces.  Pieces are range-sorted by (length, row), so each
has a rank among those of its length.  Then supersteps go from the longest length to the shortest: all pieces of a length look for
their successor, the smallest gap that holds them; where many want the same gaps, the ranks decide, piece by piece and gap by gap; the
gaps are updated and the next superstep begins.  Pieces without any gap open sequences.  The result is that of best-fit decreasing.

A superstep never touches rows.  Pieces of one length differ in rank alone and gaps of one size in the number of their sequence, so it
matches runs of ranks with runs of sequences.  Whenever pieces of length l enter a gap, less than l is left of it, under half of what it
was; so the runs number at most about the sequence's size times its logarithm, whatever the data.  They, and the counts of pieces by
range partition and length (at most partitions plus lengths), are all that the driver holds.  In the end every range partition sweeps
over the runs of its lengths and gives each piece its sequence and offset.

Null and empty texts are a document of the end id alone.  Rows of one id, null ids and repeated rows are documents of their own.  A very
long text is cut; only its last piece may be shorter than a sequence.  Ties of length go by row, as read.  An empty table gives no rows.
Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.common import small_batches, table, written

CAPACITY = 4096
#: Pieces of a range partition, about.
PART_ROWS = 1 << 19
#: str.split() cuts at these too, tokenizers don't.
SEPARATORS = re.compile("[\x1c-\x1f]")
#: Words of characters that no normalisation of text touches but for their case, and whose categories are settled.
PLAIN = re.compile("[^\u0130\u0250-\U0010ffff]+")
#: The pattern by which the tokenizer cuts words before it merges, in lower case, and a text that shows whether one does.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
PROBE = "It's THEY'RE 3.14, (a_b)--c 'tis x'd'm \u00bd\u00c9t\u00e9!? 2nd"


def visible() -> dict[int, int]:
    """The code point by which byte-level tokenizers write each byte: itself where it is printable, else the next free one from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(hidden)}


class WordEncoder:
    """The library's ids of whole texts, with the ids of each word remembered; for tokenizers that cut at white space and drop it.

    Plain words, whose characters are all below ``PLAIN``, are cut as the tokenizer does before it merges, and their pieces go to its
    merges alone.  Other fresh words go to the library joined by a special token, which is looked for before anything else, so its id
    parts theirs.  Texts that hold an added token or an information separator go to the library whole, as does everything if probes show
    that the tokenizer cuts in another way.  About ``remember`` words are kept.
    """

    def __init__(self, path: str, remember: int = 1_200_000):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        self.visible = visible()
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = [t.content for t in added.values()]
        self.parting = next(((t.content, i) for i, t in sorted(added.items()) if t.special and not t.normalized and not t.single_word and not t.lstrip and not t.rstrip), None)
        self.by_words = self.parting is not None and self._whole(" One \n two\x85one") == [*self._whole("One"), *self._whole("two"), *self._whole("one")]
        self.by_pieces = self.by_words and b"".join(map(self._plain, PROBE.split())) == np.array(self._whole(PROBE), dtype="<u4").tobytes()
        self.remember = remember
        self.words: dict[str, bytes] = {}

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _plain(self, word: str) -> bytes:
        pieces = PIECE.findall(word.lower())
        if not (word.isascii() and word.isprintable()):
            pieces = [p.encode().decode("latin-1").translate(self.visible) for p in pieces]
        return array("I", [t.id for p in pieces for t in self.merges.tokenize(p)]).tobytes()

    def _learn(self, fresh: set[str]) -> None:
        """Ids of words not met before."""
        plain = [w for w in fresh if PLAIN.fullmatch(w)] if self.by_pieces else []
        self.words.update(zip(plain, map(self._plain, plain)))
        rest = list(fresh.difference(plain))
        content, parting = self.parting
        for at in range(0, len(rest), 4096):
            own = rest[at : at + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([content.join(own)], add_special_tokens=False)[0].ids, dtype="<u4")
            parts = np.split(ids, np.flatnonzero(ids == parting))
            self.words.update((w, (p if not i else p[1:]).tobytes()) for i, (w, p) in enumerate(zip(own, parts, strict=True)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, unsigned 32-bit little-endian."""
        if len(self.words) > self.remember:
            self.words.clear()
        whole = [not self.by_words or any(a in t for a in self.added) or SEPARATORS.search(t) is not None for t in texts]
        words = [[] if w else t.split() for t, w in zip(texts, whole)]
        fresh = set().union(*words).difference(self.words)
        if fresh:
            self._learn(fresh)
        get = self.words.__getitem__
        return [np.array(self._whole(t), dtype="<u4").tobytes() if w else b"".join(map(get, own)) for t, w, own in zip(texts, whole, words)]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One for a Python worker, over all of its tasks."""
    return WordEncoder(path)


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, ids binary"
PIECES_SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """docs (doc_id, text) -> (row, doc_id, piece, start, length, ids_crc32, ids), written once; ids are unsigned 32-bit little-endian, or null unless asked for."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 250):
                b = whole.slice(at, 250)
                rows = []
                for doc_id, ids in zip(b.column(0).to_pylist(), enc.encode([t or "" for t in b.column(1).to_pylist()])):
                    data = ids + end
                    for piece, start in enumerate(range(0, len(data) // 4, capacity)):
                        part = data[4 * start : 4 * (start + capacity)]
                        rows.append((doc_id, piece, start, len(part) // 4, zlib.crc32(part), part if with_ids else None))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows), PIECES_SCHEMA)], schema=PIECES_SCHEMA)

    made = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)
    return written(made.withColumn("row", F.monotonically_increasing_id()), "pieces")


RANKED = pa.schema([("row", pa.int64()), ("length", pa.int32()), ("part", pa.int32()), ("local", pa.int64())])


def _ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by length -> the same with the range partition and the place among its rows of that length."""
    part, last, before = TaskContext.get().partitionId(), None, 0
    for b in batches:
        if not b.num_rows:
            continue
        length = b.column(1).to_numpy()
        change = np.r_[True, length[1:] != length[:-1]]
        begin = np.maximum.accumulate(np.where(change, np.arange(len(length)), 0))
        local = np.arange(len(length)) - begin
        if length[0] == last:
            local[begin == 0] += before
        last, before = length[-1], int(local[-1]) + 1
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.full(len(length), part, dtype=np.int32)), pa.array(local)], schema=RANKED)


def ranked(rows: DataFrame, count: int) -> DataFrame:
    """(row, length) -> (row, length, part, local): range-sorted by length, ties by row, so no length fills a task."""
    dealt = rows.select("row", "length").repartitionByRange(max(1, -(-count // PART_ROWS)), "length", "row").sortWithinPartitions("length", "row")
    return written(dealt.mapInArrow(_ranks, "row long, length int, part int, local long"), "ranked")


def supersteps(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Pieces by length -> the runs (length, first rank, pieces to a sequence, first sequence, offset) and the number of sequences.

    A run: the piece of rank first + k lies in sequence first sequence + k // per, at offset + (k % per) * length.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    sizes: list[int] = []  # gaps that are there, in order
    gaps: dict[int, list[tuple[int, int]]] = {}  # size -> runs of sequences (first, how many)
    opened = 0

    def put(size: int, first: int, n: int) -> None:
        if size and n:
            if size not in gaps:
                gaps[size] = []
                insort(sizes, size)
            gaps[size].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0

        def enter(size: int, first: int, n: int) -> None:
            """Pieces of this length, by rank, into n sequences with that much room."""
            nonlocal left, rank
            per = size // length
            full = min(n, left // per)
            over = left - full * per if full < n else 0
            runs.append((length, rank, per, first, capacity - size))
            put(size - per * length, first, full)
            if over:
                put(size - over * length, first + full, 1)
            put(size, first + full + bool(over), n - full - bool(over))
            rank, left = rank + full * per + over, left - full * per - over

        at = bisect_left(sizes, length)
        fitting = sizes[at:]
        for size in fitting:
            if not left:
                break
            del sizes[bisect_left(sizes, size)]
            waiting = gaps.pop(size)
            for i, (first, n) in enumerate(waiting):
                if not left:
                    for rest in waiting[i:]:
                        put(size, *rest)
                    break
                enter(size, first, n)
        if left:
            n = -(-left // (capacity // length))
            enter(capacity, opened, n)
            opened += n
    return np.array(runs, dtype=np.int64).reshape(-1, 5), opened


PLACED = pa.schema([("row", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def place(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(row, length) with different rows and lengths of 1 to capacity -> (row, sequence_id, offset): sequences from 0, gapless from offset 0."""
    if capacity >= 1 << 19:
        raise ValueError("sequences of 2**19 tokens and more are not supported")
    count = rows.count()
    own = ranked(rows, count)
    found = own.groupBy("length", "part").count().orderBy("length", "part").collect()  # at most partitions plus lengths
    if any(not 0 < r.length <= capacity for r in found):
        raise ValueError(f"lengths must be 1 to {capacity}")
    counts: dict[int, int] = {}
    base = []
    for r in found:
        base.append(counts.get(r.length, 0))
        counts[r.length] = base[-1] + r["count"]
    keys, base = np.array([r.length << 32 | r.part for r in found], dtype=np.int64), np.array(base, dtype=np.int64)
    runs, _ = supersteps(counts, capacity)
    begins = (runs[:, 0] << 44) | runs[:, 1]
    order = np.argsort(begins)
    runs, begins = runs[order], begins[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, part = b.column(1).to_numpy().astype(np.int64), b.column(2).to_numpy().astype(np.int64)
            rank = b.column(3).to_numpy() + base[np.searchsorted(keys, length << 32 | part)]
            _, first, per, sequence, offset = runs[np.searchsorted(begins, length << 44 | rank, side="right") - 1].T
            k = rank - first
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sequence + k // per), pa.array(offset + k % per * length)], schema=PLACED)

    return own.mapInArrow(run, "row long, sequence_id long, offset long")


def packed(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces() -> their columns with sequence_id and offset."""
    return made.join(place(made, capacity), "row").drop("row")


def sequences(filled: DataFrame) -> DataFrame:
    """packed() of pieces with ids -> (sequence_id, n_tokens, ids): each sequence's ids as bytes; a group is one sequence."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return filled.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    made = pieces(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return packed(made).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
