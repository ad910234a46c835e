"""A corpus pipeline over ``documents``: each stage reads the rows that its predecessor kept.

Quality rules drop documents, near-duplicate removal keeps one of each group, the secret scan replaces
secrets in the texts, the mix repeats or leaves out documents by source, and the last stage encodes what
is left. All but the last return the columns of ``documents``, whatever these are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from askwell.llm import fertility, minhash, mixing, pieces, secret_scan
from askwell.llm.common import bounded_batches, table, written
from askwell.llm.queries import PIECE_VOCABULARY, WORD_VOCABULARY, vocabulary
from askwell.session import configure


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the fertility rules keep."""
    bounded_batches(spark)
    return fertility.kept_documents(docs, vocabulary(PIECE_VOCABULARY))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    bounded_batches(spark)
    return minhash.without_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced."""
    return secret_scan.redacted(docs, vocabulary(WORD_VOCABULARY))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, and the piece ids of the whole text."""
    bounded_batches(spark)
    return pieces.encode_documents(docs, vocabulary(PIECE_VOCABULARY))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: Tokenisers, signatures and a trained forest have no SQL counterpart.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet and read again by the next."""
    docs = table(configure(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
