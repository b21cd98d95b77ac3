"""A training corpus in five stages: language, near-duplicates, secrets, mix, pieces.

Each stage takes what its predecessor kept; all but the last return the columns of ``documents``.  ``run`` writes each stage
as Parquet in the shared folder and reads it for the next one, so a lost executor costs one stage at most.

All stages read the columns of ``documents`` alone, so a table may hold others, under any name; they are left out.  An empty
table gives no rows.  What nulls, empty texts and repeated rows come to stands with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphmill.llm import langid, mixing, pieces, secrets, simhash
from glyphmill.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those that the classifier rejects go.  Null texts and texts without a letter are rejected;
    null ids, languages and sources stay; repeated rows are judged alike.  Without labelled documents nothing can be identified, and all go."""
    return langid.keep_known(docs.select(COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the smallest doc_id (null last), then by the hash of its text.  Repeated rows
    are one group; texts that are null or have no word are one group too."""
    return simhash.one_of_each(docs.select(COLUMNS))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets are replaced in their texts, whose n_chars is counted again.  Null and empty texts stay as they are; repeated rows
    change alike."""
    return secrets.redact(docs.select(COLUMNS), counted="n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, once a row; n_chars is counted again.  Texts without a word are never taken; rows without
    a source are a source of their own; repeated rows share what is left of a budget equally."""
    return mixing.repeated(docs.select(COLUMNS), counted="n_chars")


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each document, with ids and inclusion scores.  Null and empty texts have one empty segmentation; rows of one
    id and text get the same samples."""
    import public_tokenizers

    return pieces.sampled(docs, public_tokenizers.path("piece_bpe_32k.model"), lean=True)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("mix", mix), ("segment", segment)]

#: SQL expresses neither the classifier nor the hashes; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
