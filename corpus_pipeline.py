"""Corpus cleaning from raw documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows of ``docs``; all but the last
return the columns of ``docs``.  Results are written between stages in the shared folder, so a
lost executor repeats part of one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankweave.llm import decontam, langid, minhash, packing, secretscan
from rankweave.llm.common import Store, fold


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without letters or with no clear language go."""
    return langid.known(docs, langid.train(docs.filter(fold("doc_id", 4) != 2)))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five-word shingles, similarity 0.8): that of the smallest id, null ids last.

    Rows are judged one by one, so repeated rows leave one, and another text under a duplicate's id stays.
    """
    return minhash.first_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no part of a ``benchmark`` item; null texts, null ids and repeated rows stay."""
    return decontam.without_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets redacted; null texts stay null, null ids and repeated rows stay."""
    return secretscan.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 1,024 tokens; a null text is one piece, the end id, and each row has pieces of its own."""
    return packing.packed(docs)


STAGES = [
    ("language", identified),
    ("near_dedup", deduplicated),
    ("decontamination", decontaminated),
    ("secrets", secrets_redacted),
    ("packing", packed),
]
#: SQL has no tokenizer, kernel classifier or MinHash; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    store = Store(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
