"""Queries that write notes to a store batch by batch and read them back, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvial.operators import cards as C
from fluvial.operators.notes import note_store, write_notes
from fluvial.plans import queries as base
from fluvial.sinks import BatchStore
from fluvial.staging import new_path


def _written(spark: SparkSession, sf_dir: str) -> BatchStore:
    """All cards in two batches by their section and again in a third, which repeats what the first ones wrote; one is retried."""
    cards = C.numbered(base._cards(spark, sf_dir), "card_id")
    store = note_store(spark, new_path(spark, "notes"))
    write_notes(store, "first", cards.filter("section % 3 = 0"))
    write_notes(store, "second", cards.filter("section % 3 = 1"))
    write_notes(store, "all", cards)
    write_notes(store, "second", cards.filter("section % 3 = 1"))
    store.compact()
    return store


def committed_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir).read("notes").drop("note_key")


def note_write_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each batch's audit row, with its outcomes counted again."""
    store = _written(spark, sf_dir)
    counts = store.read("outcomes").groupBy("batch_id").agg(F.count_if(F.col("error") == "duplicate_note").alias("duplicates"), F.count_if(F.col("error") == "empty_field").alias("blank"), F.count("note_id").alias("notes"))
    return store.read("audit").join(counts, "batch_id")


_HTML = "replace(replace(replace(replace(replace(replace(regexp_replace({}, '\\r\\n?', chr(10), 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;'), chr(10), '<br>')"
_SQL = f"""WITH {base._CARDS_SQL}, b AS (
  SELECT 0 AS turn, 'first' AS batch_id, * FROM cards WHERE section % 3 = 0 UNION ALL SELECT 1, 'second', * FROM cards WHERE section % 3 = 1 UNION ALL SELECT 2, 'all', * FROM cards
), r AS (
  SELECT *, trim(front) = '' OR trim(back) = '' AS blank, row_number() OVER (PARTITION BY section, {base._COLLAPSE}, trim(front) = '' OR trim(back) = '' ORDER BY turn, card_id) AS r FROM b
), o AS (SELECT *, CASE WHEN blank THEN 'empty_field' WHEN r > 1 THEN 'duplicate_note' END AS error FROM r)"""

QUERIES = {f.__name__: f for f in (committed_notes, note_write_audit)}
ORACLES = {
    "committed_notes": f"{_SQL} SELECT batch_id, card_id AS note_id, section, {_HTML.format('front')} AS front, {_HTML.format('back')} AS back FROM o WHERE error IS NULL",
    "note_write_audit": f"""{_SQL}, c AS (SELECT batch_id, count(*) AS requested, count_if(error IS NULL) AS created, count_if(error IS NOT NULL) AS failed, 0::BIGINT AS skipped, min(CASE WHEN error IS NULL THEN card_id END) AS first_note,
max(CASE WHEN error IS NULL THEN card_id END) AS last_note, count_if(error IS NOT NULL AND error = 'duplicate_note') AS duplicates, count_if(error IS NOT NULL AND error = 'empty_field') AS blank, count_if(error IS NULL) AS notes FROM o GROUP BY batch_id)
SELECT *, CASE WHEN created > 0 AND failed > 0 THEN 'partial' WHEN created > 0 THEN 'success' ELSE 'failed' END AS state FROM c""",
}
