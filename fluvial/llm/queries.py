"""The queries of this package by name, over the tables in a folder; SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fluvial.llm import bpe, conversation_repair, exact_dedup, html_extract, jaccard_join, minhash, packing, sharding, token_counts, topk, toxicity, vector_codes, warc
from fluvial.staging import materialize, new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 24 shards of a weighted hash tree, and in 25."""
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), tree := sharding.topology(24), sharding.grow(tree))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of the labels outside the held-out fold."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(toxicity.training_rows(docs, _table(spark, sf_dir, "labels"))))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the one of its equal texts that stays. Null is empty; rows, ids and texts may repeat; no column but doc_id and text is read."""
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the least document that links reach. Null and empty texts link with nothing; repeated rows are copies."""
    return jaccard_join.near_components(_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences. Null and empty texts are their end id alone; repeated rows are packed each by itself."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup of all documents after batches of inserts, revisions and deletes, some of them committed again.

    All documents come with estimated counts; every count is revised to that of the tokenizer, all rows leave and come back.
    The totals are those of a recount of all documents. Null sources and languages are groups of their own.
    """
    docs = _table(spark, sf_dir, "documents")
    rollup = token_counts.Rollup(spark, new_path(spark, "token_counts"))
    first = materialize(token_counts.estimate_tokens(docs), "estimates")
    counts = materialize(token_counts.count_tokens(docs, "byte_bpe_50k"), "counts")
    rollup.commit("load", token_counts.inserts(first))
    rollup.commit("load", token_counts.inserts(first))  # a retry
    rollup.commit("tokenize", token_counts.revisions(first, counts))
    rollup.commit("withdraw", token_counts.deletes(counts))
    rollup.commit("restore", token_counts.inserts(counts))
    rollup.commit("tokenize", token_counts.revisions(first, counts))  # again, after later batches
    return rollup.totals()


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives and read back."""
    path = new_path(spark, "archives")
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents' ids and of what they decode to. Null is empty; texts of any length are encoded whole."""
    return bpe.encode_documents(_table(spark, sf_dir, "documents"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages, by costs fitted on a sample of them. Null is empty; pages of any length are read whole."""
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all vectors for every vec_id divisible by 20. Null and non-finite vectors take no part; ties go to the smaller id."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the least document that links of minhash candidates reach. Null and empty texts link with nothing; repeated rows are copies."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations after damage: their faults, and the cheapest repair with its digest. Nulls are spaces; one conversation may hold any share of the rows."""
    return conversation_repair.repair_conversations(_table(spark, sf_dir, "conversations"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as 16 indices into codebooks of 64 entries. Null and non-finite vectors take no part; rows and ids may repeat."""
    return vector_codes.product_codes(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_toxicity, op3_exact_dedup, op4_jaccard_join, op5_packing, op6_token_counts, op7_warc, op8_bpe, op9_html_extract, op10_topk, op11_minhash_dedup, op12_conversation_repair, op13_vector_codes)}
ORACLES = {"op3_exact_dedup": exact_dedup.ORACLE, "op4_jaccard_join": jaccard_join.ORACLE, "op7_warc": warc.ORACLE, "op10_topk": topk.ORACLE, "op11_minhash_dedup": minhash.ORACLE, "op12_conversation_repair": conversation_repair.ORACLE, "op13_vector_codes": vector_codes.ORACLE}
