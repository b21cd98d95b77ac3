"""Visual comparison of page images, strip by strip: how much has changed on each page, and a heatmap of it.

Pages are the images of a folder, in the order of their names; a document is a folder of pages.  Spark's image source decodes them, and a
page is cut into strips of ``STRIP`` rows by expressions, so no task holds more than a strip of either side while it compares.  The
smaller of two pages is filled with white at right and bottom, a missing one is white.  Strips of heatmaps are compressed one by one, as
pieces of one deflate stream whose checksum is put together from theirs, so a page's image is only joined in the end.

A document beyond a guard (``MOST_PAGES`` pages on a side, ``MOST_PIXELS`` in a page), without pages on a side, or with an image that can't
be read is a row with an error, and others go on.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.operators.graph import short

#: Limits of a document, what counts as changed, how much of a document may be; weights of gray in 65,536ths; the heatmap's red,
#: contrast and share of the difference.
MOST_PAGES, MOST_PIXELS = 500, 50_000_000
THRESHOLD, TOLERANCE = 12, 0.002
GRAY = (19595, 38470, 7471)
RED, CONTRAST, BLEND = (239, 68, 68), 2.5, 0.22
STRIP = 256
IMAGES = "*.{png,jpg,jpeg,bmp,gif}"
SIDES = ("before", "after")


def gray_of(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(r * GRAY[0] + g * GRAY[1] + b * GRAY[2] + 32768, 16)


def _located(path: Column, root: str) -> list[Column]:
    """The document (the folder below root, or blank) and the file of a path."""
    below = F.substring_index(path, root.rstrip("/").rpartition("/")[2] + "/", -1)
    return [F.regexp_extract(below, r"(?s)^(?:(.*)/)?([^/]*)$", i).alias(n) for i, n in ((1, "doc"), (2, "file"))]


def listed(spark: SparkSession, root: str, side: str) -> DataFrame:
    """(side, doc, file, pixels) of the images below a folder; pixels as a PNG's head says, null for other kinds."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", IMAGES).option("recursiveFileLookup", "true").load(root)
    number = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("long")
    png = F.hex(F.substring("content", 1, 8)) == "89504E470D0A1A0A"
    return files.select(F.lit(side).alias("side"), *_located(F.col("path"), root), F.when(png, number(17) * number(21)).alias("pixels"))


def guarded(files: DataFrame) -> DataFrame:
    """listed() of both sides -> (doc, error): null for documents that may be compared."""
    per = files.groupBy("doc", "side").agg(F.count("*").alias("n"), F.max("pixels").alias("pixels"))
    both = per.groupBy("doc").agg(F.max("n").alias("n"), F.max("pixels").alias("pixels"), F.count("*").alias("sides"))
    error = F.when(F.col("sides") < 2, "document has pages on one side only").when(F.col("n") > MOST_PAGES, f"document has more than {MOST_PAGES} pages").when(F.col("pixels") > MOST_PIXELS, f"a page has more than {MOST_PIXELS} pixels")
    return both.select("doc", error.alias("error"))


def pages(spark: SparkSession, root: str, side: str, docs: list[str]) -> DataFrame:
    """(side, doc, page, width, height, channels, data) of some documents; pages count from 1; width is -1 where an image can't be read."""
    folders = [f"{root.rstrip('/')}/{d}" if d else root for d in docs]
    images = spark.read.format("image").option("pathGlobFilter", IMAGES).load(folders).select("image.*")
    rows = images.select(*_located(F.col("origin"), root), "width", "height", F.col("nChannels").alias("channels"), "data")
    page = F.row_number().over(Window.partitionBy("doc").orderBy("file"))  # at most MOST_PAGES
    numbers = rows.select("doc", "file").withColumn("page", page)
    return rows.join(numbers, ["doc", "file"]).select(F.lit(side).alias("side"), "doc", "page", "width", "height", "channels", "data")


def strips(rows: DataFrame) -> DataFrame:
    """pages() -> (side, doc, page, strip, rows, width, height, channels, data): rows of pixels, blue first, STRIP of them at a time."""
    each = rows.withColumn("strip", F.explode(F.sequence(F.lit(0), F.floor((F.col("height") - 1) / STRIP).cast("int"))))
    size = F.col("width") * F.col("channels") * STRIP
    return each.withColumns({"rows": F.lit(STRIP), "data": F.substring("data", F.col("strip") * size + 1, size)})


def _canvas(data: bytes | None, width: int, channels: int, shape: tuple[int, int]) -> np.ndarray:
    """A strip as red, green, blue on white of a shape (rows, columns); gray becomes all three, transparency is left out."""
    out = np.full((*shape, 3), 255, dtype=np.uint8)
    if data:
        a = np.frombuffer(data, dtype=np.uint8).reshape(-1, width, channels)
        out[: len(a), :width] = a[:, :, :1] if channels == 1 else a[:, :, 2::-1]
    return out


def difference(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The difference of two canvases, and its gray."""
    d = np.where(left > right, left - right, right - left)
    return d, ((d.astype(np.int64) @ np.array(GRAY) + 32768) >> 16).astype(np.uint8)


def heat(right: np.ndarray, d: np.ndarray, gray: np.ndarray, mean: int, threshold: int) -> np.ndarray:
    """The right canvas, red where it has changed, with a share of the difference in high contrast; mean: of the whole page's gray."""
    contrast = np.clip(np.float32(mean) + np.float32(CONTRAST) * (d.astype(np.float32) - np.float32(mean)), 0, 255).astype(np.uint8)
    base = np.where((gray > threshold)[:, :, None], np.array(RED, dtype=np.uint8), right).astype(np.float32)
    return (base + np.float32(BLEND) * (contrast.astype(np.float32) - base)).astype(np.uint8)


def deflated(canvas: np.ndarray, last: bool) -> tuple[bytes, int, int]:
    """(piece of a deflate stream, adler32, bytes) of a strip's rows, each with filter 0."""
    raw = np.concatenate((np.zeros((len(canvas), 1), dtype=np.uint8), canvas.reshape(len(canvas), -1)), axis=1).tobytes()
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    return z.compress(raw) + z.flush(zlib.Z_FINISH if last else zlib.Z_SYNC_FLUSH), zlib.adler32(raw), len(raw)


def adler_joined(a: int, b: int, size_b: int) -> int:
    """adler32 of two texts put together, from theirs and the second's size."""
    base = 65521
    one = ((a & 0xFFFF) + (b & 0xFFFF) - 1) % base
    two = ((a >> 16) + (b >> 16) + (size_b % base) * ((a & 0xFFFF) - 1)) % base
    return two << 16 | one


def png(width: int, height: int, parts: list[tuple[bytes, int, int]]) -> bytes:
    """An image of pieces of ``deflated``, top first."""
    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    sums = 1
    for _, adler, size in parts:
        sums = adler_joined(sums, adler, size)
    data = [(b"\x78\x9c" if not i else b"") + p for i, (p, _, _) in enumerate(parts)]
    data[-1] += struct.pack(">I", sums)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + b"".join(chunk(b"IDAT", d) for d in data) + chunk(b"IEND", b"")


def paired(rows: DataFrame) -> DataFrame:
    """strips() of both sides -> a row for each strip of the larger page, with both sides' data."""
    one = rows.groupBy("doc", "page", "strip").agg(F.max("rows").alias("rows"), *(F.max(F.when(F.col("side") == s, F.col("data"))).alias(f"data{i}") for i, s in enumerate(SIDES)))
    sizes = rows.groupBy("doc", "page").agg(*(F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}{i}") for i, s in enumerate(SIDES) for c in ("width", "height", "channels")))
    return one.join(sizes, ["doc", "page"])


def _both(r: dict) -> tuple[np.ndarray, np.ndarray]:
    width, height = (max(r[f"{c}0"] or 0, r[f"{c}1"] or 0) for c in ("width", "height"))
    shape = min(r["rows"], height - r["strip"] * r["rows"]), width
    return tuple(_canvas(r[f"data{i}"], r[f"width{i}"] or 0, r[f"channels{i}"] or 1, shape) for i in (0, 1))


def measured(pairs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """paired() -> (doc, page, changed, area, changed_ratio, maximum_delta, mean, before_size, after_size, same_size)."""
    schema = pa.schema([("doc", pa.string()), ("page", pa.int32()), ("changed", pa.int64()), ("gray", pa.int64()), ("most", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                d, gray = difference(*_both(r))
                yield pa.RecordBatch.from_pylist([{"doc": r["doc"], "page": r["page"], "changed": int((gray > threshold).sum()), "gray": int(gray.sum(dtype=np.int64)), "most": int(d.max(initial=0))}], schema=schema)

    sums = pairs.mapInArrow(run, "doc string, page int, changed long, gray long, most int").groupBy("doc", "page").agg(F.sum("changed").alias("changed"), F.sum("gray").alias("gray"), F.max("most").alias("maximum_delta"))
    sizes = pairs.where("strip = 0").select("doc", "page", "width0", "height0", "width1", "height1")
    own = lambda c, i: F.coalesce(F.col(f"{c}{i}"), F.col(f"{c}{1 - i}"))  # noqa: E731  a missing page is as large as its partner
    area = F.greatest("width0", "width1").cast("long") * F.greatest("height0", "height1")
    size = lambda i: F.array(own("width", i), own("height", i)).alias(f"{SIDES[i]}_size")
    same = F.coalesce((F.col("width0") == F.col("width1")) & (F.col("height0") == F.col("height1")), F.lit(False))
    return sums.join(sizes, ["doc", "page"]).select("doc", "page", "changed", area.alias("area"), (F.col("changed") / area).alias("changed_ratio"), "maximum_delta", F.floor(F.col("gray") / area + 0.5).cast("int").alias("mean"), size(0), size(1), same.alias("same_size"))


def heatmaps(pairs: DataFrame, measures: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc, page, heatmap) as PNG."""
    schema = pa.schema([("doc", pa.string()), ("page", pa.int32()), ("strip", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("piece", pa.binary()), ("adler", pa.int64()), ("size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                left, right = _both(r)
                d, gray = difference(left, right)
                height = max(r["height0"] or 0, r["height1"] or 0)
                piece, adler, size = deflated(heat(right, d, gray, r["mean"], threshold), (r["strip"] + 1) * r["rows"] >= height)
                yield pa.RecordBatch.from_pylist([{"doc": r["doc"], "page": r["page"], "strip": r["strip"], "width": right.shape[1], "height": height, "piece": piece, "adler": adler, "size": size}], schema=schema)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                image = png(r["width"], r["height"], [(p["piece"], p["adler"], p["size"]) for p in r["parts"]])
                yield pa.RecordBatch.from_arrays([pa.array([r["doc"]]), pa.array([r["page"]], pa.int32()), pa.array([image], pa.binary())], names=["doc", "page", "heatmap"])

    rows = pairs.join(measures.select("doc", "page", "mean"), ["doc", "page"]).mapInArrow(run, "doc string, page int, strip int, width int, height int, piece binary, adler long, size long")
    parts = F.array_sort(F.collect_list(F.struct("strip", "piece", "adler", "size"))).alias("parts")
    whole = rows.groupBy("doc", "page").agg(F.max("width").alias("width"), F.max("height").alias("height"), parts)
    return whole.mapInArrow(join, "doc string, page int, heatmap binary")


def verdicts(measures: DataFrame, files: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc, pages, changed_ratio, passed): as many pages on both sides, each of its partner's size, and no more changed than the tolerance."""
    counts = files.groupBy("doc").agg(F.count_if(F.col("side") == "before").alias("n0"), F.count_if(F.col("side") == "after").alias("n1"))
    total = measures.groupBy("doc").agg(F.count("*").alias("pages"), (F.sum("changed") / F.sum("area")).alias("changed_ratio"), F.bool_and("same_size").alias("same"))
    return total.join(counts, "doc").select("doc", "pages", "changed_ratio", (F.col("same") & (F.col("n0") == F.col("n1")) & (F.col("changed_ratio") <= tolerance)).alias("passed"))


class Comparison:
    """Two folders of page images, compared: ``errors`` (doc, error), ``pages`` of measured(), ``documents`` of verdicts(), and heatmaps()."""

    def __init__(self, spark: SparkSession, before: str, after: str, threshold: int = THRESHOLD, tolerance: float = TOLERANCE):
        if not 0 <= threshold <= 255 or not 0 <= tolerance <= 1:
            raise ValueError("threshold must be 0 to 255, tolerance 0 to 1")
        self.threshold, self.tolerance = threshold, tolerance
        files = short(listed(spark, before, SIDES[0]).unionByName(listed(spark, after, SIDES[1])))
        guard = guarded(files)
        docs = [r.doc for r in guard.where("error is null").select("doc").collect()]  # paths, as a reader takes them
        self.errors = guard.where("error is not null")
        none = "side string, doc string, page int, width int, height int, channels int, data binary"
        rows = pages(spark, before, SIDES[0], docs).unionByName(pages(spark, after, SIDES[1], docs)) if docs else spark.createDataFrame([], none)
        unread = short(rows.where((F.col("width") <= 0) | (F.col("height") <= 0) | ~F.col("channels").isin(1, 3, 4) | (F.col("width").cast("long") * F.col("height") > MOST_PIXELS)).select("doc", F.lit("an image can't be read").alias("error")).distinct())
        self.errors = self.errors.unionByName(unread)
        self.pairs = short(paired(strips(rows.join(F.broadcast(unread), "doc", "left_anti"))))  # documents that can't be read: at most those listed above
        self.pages = short(measured(self.pairs, threshold))
        self.documents = verdicts(self.pages, files, tolerance)

    def heatmaps(self) -> DataFrame:
        return heatmaps(self.pairs, self.pages, self.threshold)

    def write(self, target: str) -> DataFrame:
        """Heatmaps as <doc>/page-001-diff.png and reports as <doc>/visual-comparison.json below a shared folder, each whole or not at all; returns documents with errors."""
        target = target.rstrip("/")

        def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from glyphmill.sources.word import store_of

            for b in batches:
                for r in b.to_pylist():
                    folder = f"{target}/{r['doc']}" if r["doc"] else target
                    store, at = store_of(folder)
                    store.create_dir(at, recursive=True)
                    staged = f"{at}/.{uuid.uuid4().hex}"
                    with store.open_output_stream(staged) as f:
                        f.write(r["data"])
                    store.move(staged, f"{at}/{r['name']}")
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

        images = self.heatmaps().select("doc", F.format_string("page-%03d-diff.png", "page").alias("name"), F.col("heatmap").alias("data"))
        page = F.struct("page", "changed_ratio", "maximum_delta", F.format_string("page-%03d-diff.png", "page").alias("image_path"), "before_size", "after_size")
        reports = self.pages.groupBy("doc").agg(F.array_sort(F.collect_list(page)).alias("pages")).join(self.documents.drop("pages"), "doc")
        report = F.to_json(F.struct(F.lit(self.threshold).alias("threshold"), F.lit(self.tolerance).alias("tolerance"), "pages", "changed_ratio", "passed"))
        rows = images.unionByName(reports.select("doc", F.lit("visual-comparison.json").alias("name"), F.encode(report, "UTF-8").alias("data")))
        rows.mapInArrow(publish, "n long").agg(F.sum("n")).collect()
        return self.documents.withColumn("error", F.lit(None).cast("string")).unionByName(self.errors, allowMissingColumns=True)
