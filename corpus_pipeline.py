"""A corpus pipeline of five stages, each one operator of ``rasterlens.llm``.

Each function takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``. All but the last return the
columns of ``documents``. Empty tables, nulls, repeated rows and extra columns are treated
as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rasterlens.llm import bpe, line_dedup, mixing, simhash, toxicity
from rasterlens.llm.common import dropped, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from the labels of ``sf_dir``.

    A null or empty text scores by the model's bias alone; rows that repeat a text share its
    verdict; without labels of both classes all documents get the one class that is known.
    """
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in the corpus before, or nearly so, are cut out of the texts.

    The first occurrence by (doc_id, line) stays, a null doc_id being the least; no row goes:
    null texts stay null, and a text without lines left is empty.
    """
    return line_dedup.deduplicated(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the least doc_id.

    Null and empty texts are one group; rows of one doc_id stay or go together, rows without
    a doc_id stay.
    """
    return simhash.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least; documents of small sources as often as their weight asks.

    A null source is a source; documents without words come once.
    """
    return mixing.mixed(docs, marks=False)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, with the digests of ids and decoded text; null texts are empty."""
    return bpe.digests(docs, ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", dedup_documents),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: No SQL engine trains the classifier or hashes as the stages do; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = before = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
        dropped(before)  # the given table is not one of ``written``
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
