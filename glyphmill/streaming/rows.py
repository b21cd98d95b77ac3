"""Row-level rules on streams.

Detection and repair keep no state, so they run on an unbounded DataFrame as they are; what needs a whole project (anti joins,
ordinals over a project) is for batches, or for foreachBatch over finished projects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from glyphmill.operators.candidates import candidates


def candidate_stream(paragraphs: DataFrame, mode: str = "balanced") -> DataFrame:
    """paragraphs (doc, part, paragraph_index, text) of a stream -> candidates of a stream; no state, no watermark."""
    if not paragraphs.isStreaming:
        raise ValueError("a streaming DataFrame is needed")
    return candidates(paragraphs, mode)
