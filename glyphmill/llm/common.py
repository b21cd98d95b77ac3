"""What the operators share: reading tables, cutting lineage, batches that stay small, byte n-grams.

Words are ``[^\\x20\\x09-\\x0D]+`` everywhere, which is what ``bytes.split()`` yields.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch, so that a Python worker holds few long texts at once.
BATCH_ROWS, BATCH_BYTES = 2000, 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; other columns, whatever their names, are not read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.  Only where it is unset and all runs on one machine is one of our own set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = f"file://{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bounds of an Arrow batch, which plans read when they run; bounds that are lower already stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def cut(df: DataFrame) -> DataFrame:
    """Materialises df in the shared folder, so that a lost executor costs no earlier work."""
    spark = df.sparkSession
    at = shared_dir(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(at)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """As cut(), but columnar and compressed: for wide rows.  The folder goes when the driver ends."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(removed, df.sparkSession, path)
    return df.sparkSession.read.parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Removes a folder, while the session lives."""
    if spark.sparkContext._jsc is not None:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def whole(x, scale: int):
    """floor(scale * x) of a component as a long; an error beyond 64 bits, where the cast would saturate."""
    y = F.lit(float(scale)) * x.cast("double")
    return F.when(F.abs(y) < 2.0**63, F.floor(y)).otherwise(F.raise_error(F.lit("a component is beyond 64 bits")).cast("long"))


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text is divisible by 5; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def local_path(uri: str) -> str:
    return uri[7:] if uri.startswith("file://") else uri


def bucket_hash(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


class Grams:
    """Byte n-grams of a batch of texts, hashed to buckets with numpy; no Python loop over characters.

    Every run of separators counts as one blank, and a blank stands before and after each text, so that grams see
    the ends of words.  A gram holds a blank at its ends at most.
    """

    #: Multipliers of the polynomial hash and of its finish.
    BASE, MIX = np.uint32(0x01000193), np.uint32(0x9E3779B1)

    def __init__(self, sizes: tuple[int, ...], bits: int):
        self.sizes, self.bits = sizes, bits

    def lay_out(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All texts in one array of bytes, and where each begins (one more entry: where the last ends)."""
        parts = [b" %b " % b" ".join(t.split()) for t in texts]
        ends = np.cumsum([0, *map(len, parts)])
        return np.frombuffer(b"".join(parts), dtype=np.uint8), ends

    def hashed(self, data: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each size: bucket of the gram that begins at each byte, and which of them are grams within a word."""
        blank = data == 32
        code = data.astype(np.uint32) + np.uint32(1)
        value = code.copy()
        inner = np.zeros(len(data), dtype=bool)  # a blank strictly within
        for n in range(2, max(self.sizes) + 1):
            if len(data) < n:
                return
            value = value[: len(data) - n + 1] * self.BASE + code[n - 1 :]
            inner = inner[: len(value)]
            if n > 2:
                inner = inner | blank[n - 2 : len(data) - 1]
            if n in self.sizes:
                ok = ~inner
                if n == 2:
                    ok = ok & ~(blank[:-1] & blank[1:])
                mixed = (value ^ (value >> np.uint32(15))) * self.MIX + np.uint32(n)
                yield n, (mixed >> np.uint32(32 - self.bits)).astype(np.int32), ok


def texts_of(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.to_pylist()]
