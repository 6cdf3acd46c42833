"""A training corpus from raw documents: STAGES in order, each reading what the one before wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cinefold.llm import minhash_forest, mixing, pieces, quality, substring_dedup
from cinefold.llm.tables import read, stored

# Words of a shingle in the near-duplicate stage; the two of op10 are that query's contract.
SHINGLE_WORDS = 5

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects, as they are; the toxic rule is learnt from `labels`."""
    return quality.filter_documents(docs, quality.learnt(docs, read(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near-duplicates."""
    return minhash_forest.drop_near_duplicates(docs, words=SHINGLE_WORDS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller id has too."""
    return substring_dedup.drop_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their words as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, pieces, and whether the pieces decode to the text."""
    return pieces.encode_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("substring dedup", repeated_passages),
    ("source mix", source_mix),
    ("sentencepiece", piece_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents`; every stage's rows are written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


# The near-duplicate groups, the random mix and the pieces are beyond SQL; tests hold the rows
# against a brute-force version.
ORACLE_SQL = None
