"""From raw documents to packed sequences: reject bad and toxic documents, keep one of each near-duplicate group, pack.

Each stage takes what the one before kept, written as Parquet and read again. The classifiers learn from the labelled
rows of the whole ``documents`` table, without those that the operators' queries hold out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tagweave.llm import compression_quality, packing, simhash, toxicity
from tagweave.llm.common import fold, free_name, table, written
from tagweave.llm.queries import byte_bpe


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier calls good."""
    model = compression_quality.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                                      fold(F.col("doc_id"), 5) != 0)
    name = free_name(docs, "stage_score")
    scored = compression_quality.score(docs, model, docs.columns, name)
    return scored.filter(F.col(name) >= 0.3).select(*docs.columns)


def non_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not call toxic."""
    model = toxicity.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                           fold(F.col("doc_id"), 3) != 1)
    name = free_name(docs, "stage_score")
    scored = toxicity.score(docs, model, docs.columns, name)
    return scored.filter(F.col(name) < 0.7).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (shingles of five words, similarity 0.8 or more), the one with the
    smallest doc_id."""
    return simhash.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 2048 tokens."""
    return packing.packed(docs, **byte_bpe())


STAGES = [("quality classifier", quality), ("toxicity", non_toxic), ("SimHash near-dedup", near_dedup),
          ("best-fit packing", pack)]

#: SQL cannot express the classifiers; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (_name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
