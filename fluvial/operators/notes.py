"""Cards written as notes: what each card came to, the notes themselves and an audit row, all of a batch at once or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvial.functions.labels import escaped
from fluvial.functions.text import collapsed
from fluvial.operators.review import write_batches
from fluvial.sinks import BATCH, BatchStore
from fluvial.staging import discard, join_skewed, materialize

TABLES = {
    "notes": "note_id long, section long, front string, back string, note_key binary",
    "outcomes": "card_id long, state string, error string, note_id long",
    "audit": "requested long, created long, failed long, skipped long, first_note long, last_note long, state string",
}


def note_store(spark: SparkSession, path: str) -> BatchStore:
    return BatchStore(spark, path, TABLES)


def write_notes(store: BatchStore, batch_id: str, cards: DataFrame) -> bool:
    """Write a batch of cards (card_id, section, front, back) as notes; False if the batch is there already.

    A card fails with empty_field if a side is blank (null is), and with duplicate_note if a note has its section and
    its front up to white space, or an earlier card of the batch that doesn't fail, by card_id. What fails is an outcome, no
    exception. Notes hold HTML; a note has the id of its card. A batch without cards leaves an audit row too.
    """
    if batch_id in store.committed():
        return False
    blank = (F.trim(F.coalesce("front", F.lit(""))) == "") | (F.trim(F.coalesce("back", F.lit(""))) == "")
    named = F.concat(F.coalesce(F.col("section").cast("string"), F.lit("")), F.lit("\x1f"), collapsed(F.coalesce("front", F.lit(""))))
    rows = cards.select("card_id", F.col("section").cast("long").alias("section"), "front", "back", blank.alias("blank"), F.unhex(F.sha2(named.cast("binary"), 256)).alias("note_key"))
    rows = materialize(rows, "cards_to_write")
    first = rows.filter("not blank").groupBy("note_key").agg(F.min("card_id").alias("first"))
    there = store.read("notes").select("note_key").distinct().withColumn("there", F.lit(True))
    keys = materialize(first.join(there, "note_key", "left"), "note_keys")
    found = join_skewed(rows, keys, ["note_key"], ["card_id"], "left")
    error = F.when(F.col("blank"), "empty_field").when(F.coalesce("there", F.lit(False)) | (F.col("card_id") > F.col("first")), "duplicate_note")
    found = materialize(found.withColumn("error", error).withColumn("state", F.when(error.isNull(), "created").otherwise("failed")), "card_outcomes")
    created = F.when(F.col("state") == "created", F.col("card_id"))
    audit = write_batches(found.select(F.lit(batch_id).alias(BATCH), "state", created.alias("note_id")), BATCH, F.lit(False))
    if found.isEmpty():
        audit = store.spark.range(1).select(*(F.lit(0).alias(c) for c in ("requested", "created", "failed", "skipped")), F.lit(None).alias("first_note"), F.lit(None).alias("last_note"), F.lit("success").alias("state"))
    notes = found.filter("state = 'created'").select(F.col("card_id").alias("note_id"), "section", escaped(F.col("front")).alias("front"), escaped(F.col("back")).alias("back"), "note_key")
    done = store.commit(batch_id, {"notes": notes, "outcomes": found.select("card_id", "state", "error", created.alias("note_id")), "audit": audit})
    discard(rows, keys, found)
    return done
