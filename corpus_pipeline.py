"""A corpus from raw documents to tokens, in five stages.

Each stage is an operator of ``lodeweave.llm`` and takes all rows that the one before it kept. Between
stages the rows are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodeweave.llm import mixing, pieces_bpe, quality, similar, surrogates
from lodeweave.llm.common import read, table
from lodeweave.llm.queries import PIECES
from lodeweave.session import discard

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and the thresholds of their language and source."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles that agree by 0.8 or more), that with the least id."""
    return similar.keep_one(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data replaced by surrogates. ``n_chars`` stays that of the text as it came."""
    return surrogates.hide_rows(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    return mixing.take(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text and the checks of their decoding."""
    return pieces_bpe.encode(docs, PIECES).drop("decoded")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("private_data", private_data),
    ("mix_sources", mix_sources),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Nulls, empty texts, repeated rows and empty tables are handled stage by
    stage, as each operator states."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = table(stage(spark, docs, sf_dir), name)
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)


# Fingerprints, surrogates and merges are not SQL: tests compare the rows with a brute-force version.
ORACLE_SQL = None
