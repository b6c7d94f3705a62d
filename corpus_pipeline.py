"""The training corpus from documents: five stages, each of which works on all that the one before kept.

What holds for every stage: null texts count as empty and are rejected by none but the
token packing, which gives them the separator alone; null and repeated ids, repeated rows
and columns of any name pass through; an empty table gives an empty one. All stages but the
last keep the columns of ``documents``.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession

from lamina.llm import exact_dedup, near_dedup, queries, substring_dedup, toxicity
from lamina.llm.common import remove_folder, shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7, by a lexicon learned from the labelled ones among them."""
    return toxicity.drop_toxic(docs, queries.toxicity_model(docs, table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal after lower-casing A-Z: that with the largest id."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.75 of five-word shingles: that with the smallest id."""
    return near_dedup.drop_near_duplicates(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that occurred in an earlier one."""
    return substring_dedup.drop_repeated_passages(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences of at most 2048 tokens."""
    return queries.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("packing", pack),
]

#: Scores, chunking and token ids are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again.

    What a stage wrote is deleted when the next one has; the last is the caller's.
    """
    folder = posixpath.join(shared_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        out = posixpath.join(folder, name)
        stage(spark, docs, sf_dir).write.parquet(out)
        if before is not None:
            remove_folder(spark, before)
        docs, before = spark.read.parquet(out), out
    return docs
