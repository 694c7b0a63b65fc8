"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next.

Toxicity drops the documents its classifier rejects; line dedup drops the lines
that ten documents or more share; near-dedup keeps one document of each group
(five words a shingle, similarity of 0.8 or more); decontamination drops the
documents that hold a benchmark item; mixing orders the training stream, one row
a copy, by a curriculum over the sources.  Each stage works on all its
predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialise, table
from tessera.llm.curriculum import mix_curriculum
from tessera.llm.decontaminate import decontaminate
from tessera.llm.line_dedup import dedup_lines
from tessera.llm.near_dedup import drop_near_duplicates
from tessera.llm.toxicity import drop_toxic, held_out


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from labels outside the held-out quarter."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 4, 2))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines found in ten documents or more; ``n_chars`` follows the text."""
    kept = dedup_lines(docs, min_docs=10, min_chars=1)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return drop_near_duplicates(docs, n=5, threshold="0.8")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which no benchmark item is four fifths covered; rows that share an id are judged one by one."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), by_row=True, n=5, coverage=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training stream: one row a copy, with ``copy`` and ``position``, sorted by position."""
    return mix_curriculum(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: A trained classifier decides what the first stage keeps, which SQL cannot express; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
