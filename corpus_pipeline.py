"""A corpus pipeline in stages: quality rules, exact dedup, near dedup, mixing to target weights, token ids.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pitwell.llm import exact_dedup, mixing, near_dedup, piece_codec, quality
from pitwell.llm.shared import documents, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that the quality rules reject. A null text has no words and fails the base rule; each row is judged for itself, equal rows alike."""
    return quality.kept_documents(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one row of each normalised text: the smallest id (null ids last), of tied ids one row. A null text counts as empty."""
    return exact_dedup.deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one row of each group of near copies, the smallest id. Rows without words are linked with nothing and all stay."""
    return near_dedup.one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out rows so that the sources come near their targets. A null source is one of its own; a row without words is dealt like any other and takes no words."""
    return mixing.mixed(docs)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of every row, repeated ones included; a null text is empty and has the end id alone."""
    return piece_codec.token_digests(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources", source_mix),
    ("sentence pieces", piece_ids),
]

#: The quality verdict and the near duplicates are no SQL; see the tests against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each stage's result is a table in the shared folder."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage-{k}")
    return docs
