"""From raw documents to a training mix, in five stages; each works on all rows that the one before it kept.

In every stage null texts count as empty ones, rows with null or repeated ids are rows like any other,
columns beside those of documents stay, and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import decontaminate, exact_dedup, mixing, near_copies, quality
from ledgerloom.llm.common import table, written


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds poor or toxic go; repeated rows go or stay together. Without labels nothing goes."""
    judged = quality.classify(docs, table(spark, sf_dir, "labels"))
    return judged.filter("NOT rejected").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space apart) one stays: the longest, then that of the smallest id, null last. Empty texts are equal."""
    return exact_dedup.kept_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts with at least 0.8 of their five-word shingles in common the document of the smallest id stays, null last.

    Texts of fewer words are one shingle, so copies of each other only.
    """
    return near_copies.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go; items without words have none."""
    marked = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return marked.filter("NOT contaminated").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: the documents with at least one word taken, and how many words of each; documents without words go."""
    return mixing.mix_sources(docs).filter("taken > 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", reject_poor),
    ("exact_dedup", drop_copies),
    ("simhash", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix),
]

#: A trained classifier and XXH64 fingerprints can't be said in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each one's rows written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
