"""Token ids as length-delimited binary records, with an offset index beside each shard.

Shard file ``*.rec``: for each document, in ascending doc_id order (null first, then as read)
    length of the payload, unsigned 64-bit little-endian; masked crc32 of those 8 bytes, unsigned 32-bit;
    payload: doc_id (signed 64-bit, NO_ID for null), then the ids as unsigned 16-bit or 32-bit little-endian;
    masked crc32 of the payload, unsigned 32-bit.
Index file ``*.idx``: for each record, its offset in the shard and its number of ids, unsigned 64-bit.
``manifest``: a Parquet table with a row for each shard (its order, files, records, ids), written last.  A shard's files
carry a name of their own for each attempt; only those of finished tasks are in the manifest, so a lost executor leaves
files that nothing reads.

The ids are two bytes each where the vocabulary fits.  A shard is closed at ``shard_bytes``, so a reader holds one record
and a writer one batch.  Null and empty texts have the end id only.  Repeated rows are records of their own; their order is
that of their texts; rows without an id come first.  An empty table writes a manifest without rows.  Only doc_id and text are
read, so other columns may have any name.
"""

from __future__ import annotations

import atexit
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.common import removed, shared_dir, small_batches, table

#: How TFRecord-like files mask a checksum, so that checksums of data that hold checksums stay sound.
MASK_DELTA = 0xA282EAD8
NO_ID = -(1 << 63)
#: Length and its checksum.
HEAD, HEAD_SIZE = "<QI", 12


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes | memoryview, at: int = 0) -> tuple[memoryview, int]:
    """The payload at an offset and where the next record begins; ValueError if a checksum is wrong or data end early."""
    view = memoryview(data)
    if at + HEAD_SIZE > len(view):
        raise ValueError(f"record at {at}: ends within its head")
    size, crc = struct.unpack_from(HEAD, view, at)
    if masked(bytes(view[at : at + 8])) != crc:
        raise ValueError(f"record at {at}: checksum of its length")
    start, end = at + HEAD_SIZE, at + HEAD_SIZE + size
    if end + 4 > len(view):
        raise ValueError(f"record at {at}: ends within its payload")
    payload = view[start:end]
    if masked(bytes(payload)) != struct.unpack_from("<I", view, end)[0]:
        raise ValueError(f"record at {at}: checksum of its payload")
    return payload, end + 4


#: A white space that stands after another and before a third or the end: text can't be cut there.
UNSAFE = re.compile(r"\s\s(?=\s|$)")
SPACES = re.compile(r"\s\s")


class Codes(dict):
    """Numbers pieces as they are first asked for; `fresh` lists those without ids yet."""

    def __init__(self):
        super().__init__()
        self.fresh: list = []

    def __missing__(self, piece) -> int:
        self[piece] = code = len(self)
        self.fresh.append(piece)
        return code


class Encoder:
    """The library's ids of whole texts, with the ids of each blank-separated piece remembered.

    The tokenizer cuts at every blank between non-blanks before it merges, so a text's ids are those of its pieces, each
    with the blank before it; a text's first piece, which has none, is a key of its own.  New pieces go to the library
    joined in long strings, and the bytes of its tokens tell them apart.  Texts with longer runs of white space go to the
    library whole, and so do those that hold an added token, which the library looks for first; with ``split_special`` it
    cuts special tokens like other text.  About ``remember`` pieces are kept.
    """

    def __init__(self, path: str, end_id: int, remember: int = 800_000, split_special: bool = True):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = split_special
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not (split_special and t.special)]
        self.vocabulary, self.end_id, self.remember = self.tokenizer.get_vocab_size(), end_id, remember
        self.token_bytes = np.zeros(self.vocabulary, dtype=np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.token_bytes[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.codes = Codes()
        self.pool = np.zeros(1 << 20, dtype=np.uint32)
        self.begins, self.sizes = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)  # of each code in the pool
        self.spaced = np.zeros(1 << 16, dtype=bool)  # pieces that are empty, begin or end with white space, or hold two of it in a row
        self.used = 0

    def _keep(self, codes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[self.used : self.used + len(ids)] = ids
        self.begins[codes] = self.used + np.cumsum(sizes) - sizes
        self.sizes[codes] = sizes
        self.used += len(ids)

    def _learn(self) -> None:
        """Ids of the fresh pieces.  Pieces that begin and end with a non-blank are joined; the tokenizer cuts between them."""
        fresh, self.codes.fresh = self.codes.fresh, []
        first = len(self.codes) - len(fresh)
        while len(self.codes) > len(self.begins):
            self.begins, self.sizes, self.spaced = (np.concatenate((x, np.zeros_like(x))) for x in (self.begins, self.sizes, self.spaced))
        plain = []
        for i, p in enumerate(fresh):
            words = (p if type(p) is str else p[0]).split()
            if len(words) != 1 or len(words[0]) != len(p if type(p) is str else p[0]):
                own = p if type(p) is str else p[0]
                outer = not words or own[0].isspace() or own[-1].isspace()
                self.spaced[first + i] = outer or SPACES.search(own) is not None
                if outer:
                    continue
            if type(p) is str:
                plain.append(i)
        for at in range(0, len(plain), 4096):
            part = plain[at : at + 4096]
            texts = [" " + fresh[i] for i in part]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(texts)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            stops = np.searchsorted(np.cumsum(self.token_bytes[ids]), np.cumsum([len(t.encode()) for t in texts])) + 1
            self._keep(first + np.array(part), ids, np.diff(stops, prepend=0))
        joined = set(plain)
        rest = [i for i in range(len(fresh)) if i not in joined]
        if rest:
            found = [e.ids for e in self.tokenizer.encode_batch_fast([" " + p if type(p) is str else p[0] for p in map(fresh.__getitem__, rest)], add_special_tokens=False)]
            self._keep(first + np.array(rest), np.array([x for ids in found for x in ids], dtype=np.uint32), np.array([len(ids) for ids in found]))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.codes) > self.remember:
            self._forget()
        get, coded = self.codes.__getitem__, []
        for t in texts:
            if any(a in t for a in self.added):
                coded.append(None)
                continue
            pieces = t.split(" ")
            pieces[0] = (pieces[0],)
            coded.append(np.fromiter(map(get, pieces), dtype=np.int64, count=len(pieces)))
        self._learn()
        # only pieces with white space of their own can bring three of it, or two at the end, together
        coded = [None if c is not None and self.spaced[c].any() and UNSAFE.search(t) else c for t, c in zip(texts, coded)]
        end, out = np.array([self.end_id], dtype=np.uint32), []
        for t, codes in zip(texts, coded):
            if codes is None:
                ids = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype=np.uint32)
            else:
                begin, size = self.begins[codes], self.sizes[codes]
                ends = np.cumsum(size)
                ids = self.pool[np.arange(ends[-1]) + np.repeat(begin - ends + size, size)]
            out.append(np.concatenate((ids, end)))
        return out


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int) -> Encoder:
    """One for a Python worker, over all of its tasks."""
    return Encoder(path, end_id, split_special=False)


def _encoded(batches: Iterator[pa.RecordBatch], enc: Encoder) -> Iterator[tuple[int | None, np.ndarray]]:
    for whole in batches:
        for at in range(0, whole.num_rows, 250):
            b = whole.slice(at, 250)
            yield from zip(b.column(0).to_pylist(), enc.encode([t or "" for t in b.column(1).to_pylist()]))


def _writer(folder: str, path: str, end_id: int, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        enc = encoder(path, end_id)
        kind = "<u2" if enc.vocabulary <= 1 << 16 and end_id < 1 << 16 else "<u4"
        rows: list[dict] = []
        data = index = None
        seq = size = 0

        def close() -> None:
            nonlocal data, index, size
            if data is not None:
                data.close()
                index.close()
                data, index, size = None, None, 0

        for doc_id, ids in _encoded(batches, enc):
            if size >= shard_bytes:
                close()
            if data is None:
                name = f"{task.partitionId():06d}-{seq:06d}-{uuid.uuid4().hex}"
                data, index = store.open_output_stream(f"{root}/{name}.rec"), store.open_output_stream(f"{root}/{name}.idx")
                rows.append({"part": task.partitionId(), "seq": seq, "name": name, "width": int(kind[-1]), "n_docs": 0, "n_ids": 0})
                seq += 1
            record = frame(struct.pack("<q", NO_ID if doc_id is None else doc_id) + ids.astype(kind).tobytes())
            index.write(struct.pack("<QQ", size, len(ids)))
            data.write(record)
            size += len(record)
            rows[-1]["n_docs"] += 1
            rows[-1]["n_ids"] += len(ids)
        close()
        yield pa.RecordBatch.from_pylist(rows, schema=MANIFEST)

    return run


MANIFEST = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("name", pa.string()), ("width", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


#: Bytes of input that one task sorts and encodes.
PART_BYTES = 256 << 20


def parts_for(docs: DataFrame) -> int:
    """Parts of about PART_BYTES of the input, as its files' sizes say, but not fewer than the session's shuffle partitions."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size if size < 1 << 60 else 0  # plans without statistics say 8 EB
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known // PART_BYTES))


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, shard_bytes: int = 64 << 20) -> DataFrame:
    """docs (doc_id, text) -> the manifest, read from the folder.

    The id ranges come from ids alone, and only (doc_id, text) is dealt out, once.
    """
    spark = docs.sparkSession
    small_batches(spark)
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    n = parts_for(docs)
    dealt = docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(_writer(folder, tokenizer, end_id, shard_bytes), "part int, seq int, name string, width int, n_docs long, n_ids long").write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def starts_of(manifest: DataFrame) -> DataFrame:
    """The manifest with first_id: the ids of all shards before.  Prefix sums in two levels: over a part's shards, and over the parts, which are as many as tasks wrote."""
    from pyspark.sql import Window

    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = parts.withColumn("base", F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", F.coalesce("base", F.lit(0)).alias("base"))
    own = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return manifest.withColumn("own", own).join(before, "part").select("name", "width", (F.col("base") + F.col("own")).alias("first_id"))


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for row in b.to_pylist():
                start, out = row["first_id"], []
                with store.open_input_stream(f"{root}/{row['name']}.rec", buffer_size=1 << 20) as f:
                    while head := f.read(HEAD_SIZE):
                        size = struct.unpack(HEAD, head)[0]
                        payload, _ = unframe(b"".join((head, f.read(size + 4))))
                        ids = np.frombuffer(payload, dtype=f"<u{row['width']}", offset=8).astype("<u4")
                        doc_id = struct.unpack_from("<q", payload)[0]
                        out.append({"doc_id": None if doc_id == NO_ID else doc_id, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes())})
                        start += len(ids)
                        if len(out) >= 4096:
                            yield pa.RecordBatch.from_pylist(out, schema=ROWS)
                            out = []
                yield pa.RecordBatch.from_pylist(out, schema=ROWS)

    return run


ROWS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_digests(folder: str, manifest: DataFrame) -> DataFrame:
    """What the files hold: (doc_id, start, n_tokens, ids_crc32).  Shards are dealt out over the tasks."""
    spark = manifest.sparkSession
    rows = starts_of(manifest).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "name")
    return rows.mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _record_at(f, at: int, width: int) -> tuple[int | None, np.ndarray]:
    f.seek(at)
    head = f.read(HEAD_SIZE)
    payload, _ = unframe(head + f.read(struct.unpack(HEAD, head)[0] + 4))
    doc_id = struct.unpack_from("<q", payload)[0]
    return None if doc_id == NO_ID else doc_id, np.frombuffer(payload, dtype=f"<u{width}", offset=8).astype(np.uint32)


def read_record(folder: str, name: str, width: int, k: int) -> tuple[int | None, np.ndarray]:
    """Record k of a shard through its offset index: (doc_id, ids), without reading those before it."""
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{root}/{name}.idx") as f:
        f.seek(16 * k)
        at = struct.unpack("<QQ", f.read(16))[0]
    with store.open_input_file(f"{root}/{name}.rec") as f:
        return _record_at(f, at, width)


def shuffled(folder: str, shards: list[tuple[str, int]], seed: int, at_once: int = 8) -> Iterator[tuple[int | None, np.ndarray]]:
    """All records of some shards (name, width) in an order set by the seed, through their indexes.

    Shards come in random order, `at_once` of them at a time, whose records are read in random order; so many offset arrays and
    open files are held.
    """
    store, root = fs.FileSystem.from_uri(folder)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(shards))
    for first in range(0, len(order), at_once):
        group = [shards[i] for i in order[first : first + at_once]]
        offsets = [np.frombuffer(store.open_input_stream(f"{root}/{name}.idx").read(), dtype="<u8").reshape(-1, 2)[:, 0] for name, _ in group]
        files = [store.open_input_file(f"{root}/{name}.rec") for name, _ in group]
        which = np.repeat(np.arange(len(group)), [len(o) for o in offsets])
        within = np.concatenate([np.arange(len(o)) for o in offsets])
        for i in rng.permutation(len(which)):
            yield _record_at(files[which[i]], int(offsets[which[i]][within[i]]), group[which[i]][1])
        for f in files:
            f.close()


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    atexit.register(removed, spark, folder)
    manifest = write(table(spark, sf_dir, "documents", "doc_id", "text"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_digests(folder, manifest)
