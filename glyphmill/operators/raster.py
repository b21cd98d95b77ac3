"""Comparison of page rasters held as pixel rows (doc pages: side, page, x, y, r, g, b)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.images import gray_of

WHITE = 255


def geometry(pixels: DataFrame) -> DataFrame:
    """(page, w0, h0, w1, h1); a missing side is null."""
    size = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c) + 1))
    return pixels.groupBy("page").agg(size("before", "x").alias("w0"), size("before", "y").alias("h0"), size("after", "x").alias("w1"), size("after", "y").alias("h1"))


def page_diffs(pixels: DataFrame, threshold: int = 12) -> DataFrame:
    """(page, changed, area, changed_ratio, maximum_delta, same_size): the smaller page is filled with white at right and bottom, a missing one is white.

    Both sides of a pixel meet in one aggregate on (page, x, y), so there is no join; a page's pixels are spread over all tasks.
    """
    one = lambda side, c: F.coalesce(F.max(F.when(F.col("side") == side, F.col(c))), F.lit(WHITE))
    both = pixels.groupBy("page", "x", "y").agg(*(one(s, c).alias(f"{c}{i}") for i, s in enumerate(("before", "after")) for c in "rgb"))
    delta = {c: F.abs(F.col(f"{c}0") - F.col(f"{c}1")) for c in "rgb"}
    gray = gray_of(delta["r"], delta["g"], delta["b"])
    sums = both.groupBy("page").agg(F.count_if(gray > threshold).alias("changed"), F.max(F.greatest(*delta.values())).alias("maximum_delta"))
    g = geometry(pixels)
    area = F.greatest(F.coalesce("w0", "w1"), F.coalesce("w1", "w0")) * F.greatest(F.coalesce("h0", "h1"), F.coalesce("h1", "h0"))
    same = (F.col("w0") == F.col("w1")) & (F.col("h0") == F.col("h1"))
    return sums.join(g, "page").select("page", "changed", area.cast("long").alias("area"), (F.col("changed") / area).alias("changed_ratio"), "maximum_delta", F.coalesce(same, F.lit(False)).alias("same_size"))


def verdict(diffs: DataFrame, tolerance: float = 0.002) -> DataFrame:
    """One row: ratio weighted by area, whether all pages have a partner of their size, and whether that passes."""
    total = diffs.agg((F.sum("changed") / F.sum("area")).alias("ratio"), F.bool_and("same_size").alias("same_geometry"), F.count("*").alias("pages"))
    return total.withColumn("passed", F.col("same_geometry") & (F.col("ratio") <= tolerance))
