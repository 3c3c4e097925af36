"""Token counts as rollups that are kept up to date by deltas.

Each batch of changes is summed to signed totals by source, language and tokenizer version and stored under its
batch id, in a store of atomic commits (fluvial/sinks.py): a reader sees a batch as it was or as it is, and a job that
dies changes nothing. Storing a batch again replaces its own totals and nothing else, so a batch that is retried, or
committed twice, counts once; so does one that is committed again with other changes, or with none left. The rollup is the
sum of all batches: sums of sums, so its cost follows the number of groups and batches, never the corpus; `compact` makes
few files of many batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvial.llm.bpe import encoder, share_vocabulary, texts
from fluvial.sinks import BatchStore
from fluvial.staging import bounded_batches

DIMENSIONS = ("source", "lang", "tokenizer_version")
MEASURES = ("n_docs", "n_tokens", "n_bytes")
STORED = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long, n_bytes long"


def count_tokens(docs: DataFrame, version: str, vocabulary: str | None = None) -> DataFrame:
    """docs' doc_id, source, lang with tokenizer_version, n_tokens and n_bytes of the whole text; null and empty texts have none.

    One row per row of docs, repeated ones too; texts of any length are counted whole. An empty table gives an empty
    result; other columns, whatever their names, are ignored.
    """
    bounded_batches(docs.sparkSession)
    spec = share_vocabulary(docs.sparkSession, vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec.value)
        for batch in batches:
            n = pa.array([len(enc.encode(t)) for t in texts(batch["text"])], pa.int64())
            yield pa.record_batch([batch["doc_id"], batch["source"], batch["lang"], n, batch["n_bytes"]], ["doc_id", "source", "lang", "n_tokens", "n_bytes"])

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text", size)
    return rows.mapInArrow(count, "doc_id long, source string, lang string, n_tokens long, n_bytes long").withColumn("tokenizer_version", F.lit(version))


def estimate_tokens(docs: DataFrame, version: str = "bytes_by_4") -> DataFrame:
    """The same columns with a quarter of the bytes, rounded up, as n_tokens: what is known of documents before they are tokenized."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.ceil(size / 4).alias("n_tokens"), size.alias("n_bytes"), F.lit(version).alias("tokenizer_version"))


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*DIMENSIONS, F.lit(1).cast("long").alias("n_docs"), "n_tokens", "n_bytes")


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*DIMENSIONS, F.lit(-1).cast("long").alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"), (-F.col("n_bytes")).alias("n_bytes"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Revised counts: the old ones leave, the new ones come, in whatever group each of them is."""
    return deletes(old).unionByName(inserts(new))


class Rollup:
    """Totals of all committed batches in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path, self.store = path, BatchStore(spark, path, {"totals": STORED})

    def commit(self, batch_id: str, deltas: DataFrame) -> None:
        """Store the batch's signed totals, in place of those it may have. Of a batch without rows nothing counts any more.

        Deltas may repeat; each counts. Null dimensions are groups of their own, null measures count nothing.
        """
        self.store.commit(batch_id, {"totals": deltas.groupBy(*DIMENSIONS).agg(*(F.sum(m).alias(m) for m in MEASURES))}, replace=True)

    def compact(self) -> bool:
        """Make few files of the batches' many; all of them can still be committed again."""
        return self.store.compact()

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, n_docs, n_tokens, n_bytes of groups that have documents. Null is a group of its own."""
        return self.store.read("totals").groupBy(*DIMENSIONS).agg(*(F.sum(m).alias(m) for m in MEASURES)).filter("n_docs <> 0 or n_tokens <> 0 or n_bytes <> 0")
