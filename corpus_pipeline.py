"""From raw documents to packed sequences: four stages, each on all that the one before has kept.

In every stage a null text is an empty one, ids and rows may repeat or be null, texts are read whole, an empty table gives
an empty one, and columns beside doc_id and text, whatever their names, are handed on (the last stage returns its own).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fluvial.llm import exact_dedup, jaccard_join, packing, toxicity
from fluvial.staging import discard, materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of the labels doesn't predict toxic. Without labels of both kinds all stay."""
    model = toxicity.fit(toxicity.training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity.keep_clean(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that with the least doc_id, and any one of those that repeat it."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with the least doc_id of each group of near copies. Rows without words or without a doc_id stay."""
    return jaccard_join.keep_least(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("n-gram Jaccard join", drop_near_copies), ("packing", pack)]

#: Toxicity and packing have no SQL form; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        if before is not None:
            discard(before)
        before = docs
    return docs
