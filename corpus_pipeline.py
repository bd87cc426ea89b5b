"""A corpus pipeline of stages; each is written as Parquet and read again as the next one's documents.

Null texts count as empty and stay null, an empty table goes through as such, extra columns of any name are carried to the last
stage, and rows that are repeated wholly leave the second stage once. A stage's folder goes when the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlens.llm import exact, jaccard, packing, suffixes, toxicity
from cohortlens.llm.common import shared_path, table
from cohortlens.session import passing, remove


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that a classifier learned from the labels finds toxic: a score of 0.5 or more. Without labels of both classes nothing goes, unless all are toxic."""
    return toxicity.accepted(docs, toxicity.fit(*toxicity.training_rows(docs, table(spark, sf_dir, "labels"))))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space: the longest, of these the smallest identifier, null first; of repeated rows one."""
    return exact.kept_rows(docs)


def apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest identifier of each group of near copies."""
    return jaccard.representatives(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 400 bytes and more that also stand elsewhere."""
    return suffixes.cleaned(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, at least one a document; a null text is its closing token."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", clean), ("exact", distinct), ("jaccard", apart), ("suffixes", unrepeated), ("packing", packed)]
#: The stages hold a trained classifier, graph components and a packing: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_path(spark, name)
        passing(stage(spark, docs, sf_dir)).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove(spark, last)
        last = path
    return docs
