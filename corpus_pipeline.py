"""The training-data pipeline: five stages over the table of documents.

Documents without a recognised language go; of equal texts one stays, then one of each
group of near duplicates; documents that hold benchmark text go; the rest is encoded.
Every stage's rows are written below the shared folder and read again by the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eventmill.llm import contamination, dedup, jaccard, langid, pieces
from eventmill.llm.queries import reachable, table
from eventmill.session import stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in learned languages; all with letters where none is learned."""
    return langid.drop_unidentified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, up to white space, the document with the smallest id."""
    return dedup.drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by links of Jaccard 0.8 or more, that with the smallest id."""
    return jaccard.keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return contamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece ids, their number, and whether they decode to the text."""
    return pieces.encode_texts(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard", near_dedup),
    ("decontaminate", decontaminate),
    ("sentencepiece", encode),
]

#: Language and piece ids come from models, which SQL can't express; tests hold the stages
#: against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(reachable(spark), sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
